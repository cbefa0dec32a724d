"""Whole evaluations, and the query catalogue on the given tables."""
