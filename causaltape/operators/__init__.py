"""Joins, lifecycles, paths, statistics and reports."""
