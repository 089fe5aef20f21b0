"""Streams of snapshot files."""
