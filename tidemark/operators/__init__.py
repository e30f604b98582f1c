"""Relational operators as functions ``DataFrame -> DataFrame``."""

from .relational import aggregate, explain, filter_expr, filter_int, filter_string, hash_join, project, scan, sort

__all__ = ["aggregate", "explain", "filter_expr", "filter_int", "filter_string", "hash_join", "project", "scan", "sort"]
