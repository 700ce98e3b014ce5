"""Operators of a training-data pipeline, each on documents at large."""
