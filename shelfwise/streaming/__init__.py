"""Structured Streaming forms of the keyed feeds."""
