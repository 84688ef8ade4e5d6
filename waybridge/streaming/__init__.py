"""Structured Streaming jobs on the batch operators."""
