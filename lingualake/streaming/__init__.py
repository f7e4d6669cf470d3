"""Parsing as a stream."""
