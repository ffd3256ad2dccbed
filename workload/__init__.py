"""Registered queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from workload.base import ORACLES, QUERIES
from workload import documents, names, scopes, runs, training, logs, joins, consistency, pruning, grids, capacity, records, files, streams  # noqa: F401,E501

__all__ = ["ORACLES", "QUERIES"]
