"""Registered queries of the detection library: name -> (query, SQL or None)."""

from __future__ import annotations


def all_queries() -> dict:
    from lodestone.plans import content, detection, graphs, records

    return {**detection.QUERIES, **records.QUERIES, **graphs.QUERIES, **content.QUERIES}
