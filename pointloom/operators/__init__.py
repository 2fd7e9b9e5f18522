"""Part of pointloom."""
