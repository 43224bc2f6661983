"""Operators of the engine: DataFrames in, DataFrames out, batched over queries by ``query_id``."""
