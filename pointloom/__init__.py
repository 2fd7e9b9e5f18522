"""Pointloom: point-cloud analytics as DataFrame operators."""
