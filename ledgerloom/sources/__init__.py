"""Readers and writers of statements."""
