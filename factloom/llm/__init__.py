"""Operators for preparing training data; queries.py registers one query for each of them."""
