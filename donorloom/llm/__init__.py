"""Operators of a training-data pipeline: each module holds one, ``queries`` applies them to the tables."""
