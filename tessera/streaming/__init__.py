"""Structured Streaming jobs (an extension; the batch operators do the work)."""
