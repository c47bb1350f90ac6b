"""Every operator as a query over the test tables, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from tessella.plans import aggregates, changes, filters, joins, search  # noqa: F401
from tessella.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
