"""Registered queries, each with the SQL that must give the same rows."""

from registered import (  # noqa: F401
    counted,
    documents,
    extensions,
    filters,
    histograms,
    hits,
    lookups,
    observed,
    requests,
    searches,
    skipping,
    sources,
)
from registered.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
