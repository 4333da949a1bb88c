"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from codeloom.plans import operator_queries, queries

assert operator_queries  # registers its queries with those of ``queries``
QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
