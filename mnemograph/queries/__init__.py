"""Registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from mnemograph.queries import evaluation, pipeline, plans, records, retrieval, scalars  # noqa: F401
from mnemograph.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["q1_vector_search"](spark, sf_dir)
