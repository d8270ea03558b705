"""Operators of a training-data pipeline: ten of them, each by a named method.

Nothing else in the library imports this package. Every operator takes a DataFrame,
the names of its columns and documented parameters, and reads no other columns, so
extra columns of any name are harmless.
"""
