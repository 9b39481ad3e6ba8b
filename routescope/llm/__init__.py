"""Operators for preparing training text, each on Spark, and the queries that apply them."""
