"""Every query of the library by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import composed, documents, fusion, graphs, iterative, modes, storage, temporal, texts, vectors

_PARTS = (vectors, fusion, texts, documents, graphs, modes, temporal, composed, iterative, storage)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for m in _PARTS for n, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for m in _PARTS for n, s in m.ORACLE_SQL.items()}
FLAGSHIP = "hybrid_mode"
