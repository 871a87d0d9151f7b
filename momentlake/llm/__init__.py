"""Operators for large-scale training-data pipelines; nothing else in momentlake imports this subpackage."""
