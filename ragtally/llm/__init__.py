"""Operators for training-data pipelines at corpus scale.

Nothing else in the library imports this subpackage; the registered queries
are in :mod:`ragtally.llm.queries`.
"""
