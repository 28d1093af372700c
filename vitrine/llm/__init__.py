"""Operators for preparing training data at scale.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; the thin queries that bind them to the driver's tables are in
``queries.py``.
"""
