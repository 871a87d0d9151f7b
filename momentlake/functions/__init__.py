"""Functions of momentlake."""
