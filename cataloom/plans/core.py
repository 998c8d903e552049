"""All queries of the analytics operators and their SQL."""

from __future__ import annotations

from cataloom.plans import catalogue, matching, opinions, pricing, retrieval

_PARTS = (pricing, catalogue, matching, opinions, retrieval)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
