"""Plans of momentlake."""
