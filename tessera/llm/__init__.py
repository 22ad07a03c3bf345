"""Operators for building training corpora: deduplication, filtering, tokenising, packing and sharding.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames, selects the
columns that it needs first (so that further columns, whatever their names, never clash) and keeps
its intermediate tables in the folder that ``spark.checkpoint.dir`` names.
"""
