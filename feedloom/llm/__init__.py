"""Operators for large training-data pipelines; queries.py registers one query for each."""
