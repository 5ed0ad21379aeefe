"""Queries of problem 2."""

from __future__ import annotations

from ..session import read_table
from .pairs import defective_pairs


def p2_found(spark, sf):
    return defective_pairs(read_table(spark, f"{sf}/tool_turns.parquet"))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
