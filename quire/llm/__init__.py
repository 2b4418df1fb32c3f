"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this package; the queries of its operators
are in ``quire.llm.queries`` and their SQL in ``quire.llm.oracles``.
"""
