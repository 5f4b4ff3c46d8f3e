"""Readers of source files and requests."""
