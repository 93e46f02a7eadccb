"""Streams of keyed rows."""
