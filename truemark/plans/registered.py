"""All registered queries of the library and their SQL."""

from __future__ import annotations

from truemark.plans import catalogue, maintenance

assert maintenance  # importing it registers its queries

QUERIES = dict(sorted(catalogue.QUERIES.items()))
ORACLES = dict(sorted(catalogue.ORACLES.items()))
