"""Every registered query of the engine with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscale.operators import budgets, claims, clauses, excerpts, gates, grids, intervals, ledger, lexical, reading, records, review, views, wording
from folioscale.plans import build, discovery, releases
from folioscale.sources import readers
from folioscale.streaming import ingest

_MODULES = [lexical, gates, reading, ledger, claims, budgets, grids, review, views, wording, records, excerpts, intervals, clauses, readers, releases, build, discovery, ingest]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
