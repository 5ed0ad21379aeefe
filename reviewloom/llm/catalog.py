"""The queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("q_copies", "q_pairs", "q_lookalike", "q_truncation", "q_personal", "q_topn", "q_frequency", "q_packing", "q_stuffing")


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Query]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
