"""Operators of a training-data pipeline, with their own queries and checks."""
