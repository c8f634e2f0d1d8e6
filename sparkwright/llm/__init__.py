"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; each module's docstring states the method, the result for
nulls, empty and very long texts, ties, repeated rows and empty tables, and
what is bounded.
"""
