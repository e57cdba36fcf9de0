"""Operators of a training-data pipeline over text and terms. Nothing else in the library imports this package."""
