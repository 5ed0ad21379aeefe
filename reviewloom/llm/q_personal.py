"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from .personal import KINDS, occurrences, redacted


def p5_found(spark, sf):
    found = occurrences(read_table(spark, f"{sf}/reviews.parquet"), "request_id", "text")
    return found.where(F.col("kind").isin(*KINDS)).select(F.col("record_id").alias("request_id"), "kind", "nth")


def p5_redacted(spark, sf):
    return redacted(read_table(spark, f"{sf}/reviews.parquet"), "request_id", "text").select(F.col("record_id").alias("request_id"), "text")


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
SQL: dict[str, str] = {}
