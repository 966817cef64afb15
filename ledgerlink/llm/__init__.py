"""Operators of a training-data pipeline: one module an operator, general interface
first; ``queries.py`` holds the thin registered queries."""
