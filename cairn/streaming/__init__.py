"""Structured Streaming forms of the incremental computations."""
