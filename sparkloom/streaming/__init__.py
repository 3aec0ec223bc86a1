"""Structured Streaming forms of the usage statistics and of batch retrieval."""
