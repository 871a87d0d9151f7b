"""Sources of momentlake."""
