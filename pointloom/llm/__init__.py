"""Operators for large-scale training-data pipelines; nothing else in pointloom imports this subpackage."""
