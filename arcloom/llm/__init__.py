"""Operators for large-scale text corpora. Nothing else in the package imports this one."""
