"""Registered queries: each has a callable ``(spark, folder) -> DataFrame`` and, where SQL
can express it on whole tables, an equivalent statement for another engine."""

from __future__ import annotations


def catalogue() -> dict[str, tuple]:
    """Name -> (callable, SQL or None) of all queries of the core."""
    from loomwork.plans import files, general, records, reference

    assert files and records  # their queries are entered in the catalogue of reference
    return general.QUERIES | reference.QUERIES
