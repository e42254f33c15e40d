"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. The queries over the driver
tables and their DuckDB SQL are in ``trustlens.llm.queries``.
"""
