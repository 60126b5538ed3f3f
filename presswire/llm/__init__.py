"""Operators of a large training-data pipeline, and the queries that run them."""
