"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames, reads
only the columns it names (so extra columns never clash) and states what it does with nulls, empty and very
long texts, ties, repeated rows and empty tables.
"""
