"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; `queries.py` registers the thin queries that apply them to whole tables.
"""
