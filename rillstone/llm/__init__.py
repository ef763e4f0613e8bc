"""Operators for large training-text pipelines, and the queries that run them over whole tables.

Nothing outside this subpackage imports it.
"""
