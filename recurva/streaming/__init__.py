"""Streams of change records."""
