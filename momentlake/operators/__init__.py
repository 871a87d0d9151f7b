"""Operators of momentlake."""
