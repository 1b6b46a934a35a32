"""Comprehensions, and the catalog of queries."""
