"""Readers and writers: markdown folders, chunk stores, tables."""
