"""Structured Streaming jobs.  Each is a function of a streaming (or batch)
DataFrame; the caller starts the query."""
