"""Structured Streaming versions of the two append-only feeds."""
