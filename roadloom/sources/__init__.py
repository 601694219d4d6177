"""Readers and writers of line networks."""
