"""Structured Streaming twins of some operators."""
