"""Relational operators: ingest, retrieval, memory, grading and routing."""
