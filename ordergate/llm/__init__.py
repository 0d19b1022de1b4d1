"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; :mod:`ordergate.llm.registry`
holds its queries and SQL.
"""
