"""Streaming of momentlake."""
