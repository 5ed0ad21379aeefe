"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from .stuffing import stuffed_pages, stuffed_shares


def p10_found(spark, sf):
    return stuffed_pages(read_table(spark, f"{sf}/documents.parquet"), "doc_id", "text").select(F.col("record_id").alias("doc_id"))


def p10_shares(spark, sf):
    """The share of each text that is no prose."""
    return stuffed_shares(read_table(spark, f"{sf}/documents.parquet"), "doc_id", "text").select(F.col("record_id").alias("doc_id"), "share")


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
SQL: dict[str, str] = {}
