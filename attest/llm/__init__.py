"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` list what the entry module registers.
"""
