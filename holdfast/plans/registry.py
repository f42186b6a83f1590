"""All registered queries and their SQL twins."""

from __future__ import annotations

from holdfast.plans import manifest  # noqa: F401  it registers its queries
from holdfast.plans.queries import ORACLE, QUERIES

FLAGSHIP = "asof_nearest_all"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
