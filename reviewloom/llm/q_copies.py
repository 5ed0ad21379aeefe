"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from .copies import copy_groups


def p1_found(spark, sf):
    groups = copy_groups(read_table(spark, f"{sf}/reviews.parquet"), "request_id", "text")
    return groups.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))


def p1_collapsed(spark, sf):
    """One row a record: its representative, the smallest id, and how many copies it had."""
    groups = copy_groups(read_table(spark, f"{sf}/reviews.parquet"), "request_id", "text")
    return groups.where(F.col("id") == F.col("first_id")).select(F.col("id").alias("request_id"), "copies")


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}
SQL: dict[str, str] = {}
