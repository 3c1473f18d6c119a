"""Structured Streaming jobs: incremental forms of the batch operators."""
