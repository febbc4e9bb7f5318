"""Structured Streaming forms of the conversation state."""
