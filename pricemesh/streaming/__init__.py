"""Structured Streaming forms of the upsert and of the search history."""
