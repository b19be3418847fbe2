"""Structured Streaming forms of the long-running processes."""
