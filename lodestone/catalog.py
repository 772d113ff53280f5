"""All registered queries and their SQL."""

from __future__ import annotations

from lodestone.plans import files, surface  # noqa: F401  (their queries register on import)
from lodestone.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "rrf_diverse"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
