"""Registered queries over the driver tables."""

from __future__ import annotations


def all_queries():
    from passagelake.catalog import registry
    from passagelake.catalog import evaluation, indexing, learning, model_stages, retrieval, streams  # noqa: F401  registers on import

    return dict(registry.QUERIES), dict(registry.ORACLES)
