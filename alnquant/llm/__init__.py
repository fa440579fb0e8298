"""Operators for large-scale training-text pipelines.  Nothing outside this subpackage imports it."""
