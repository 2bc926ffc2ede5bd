"""Training-data operators: deduplication, quality, extraction, scoring, tokenising, packing.

Nothing else in ``talkloom`` imports this subpackage.  Operators take DataFrames and
column names, read nothing but those columns, and return new DataFrames.
"""
