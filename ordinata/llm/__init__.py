"""Operators for preparing training data: texts, vectors and pages at corpus size.

Nothing outside this package imports it.  Operators take and return
DataFrames; `queries` holds the thin queries that apply them to whole tables.
"""
