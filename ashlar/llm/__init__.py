"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it. Every operator here defines what it does
with nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns in its docstring, and none of them caps, samples or drops rows.
"""
