"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from .truncation import cut_shares, cut_values


def _values(spark, sf):
    turns = read_table(spark, f"{sf}/tool_turns.parquet").select("turn_id", F.col("response.content").alias("content"), F.col("response.model").alias("model"))
    reviews = read_table(spark, f"{sf}/reviews.parquet")
    return (("text", cut_values(reviews, "request_id", "text", "channel")), ("content", cut_values(turns, "turn_id", "content", "model")))


def p4_found(spark, sf):
    parts = [v.where("cut").select(F.lit(name).alias("field_name"), "record_id") for name, v in _values(spark, sf)]
    return parts[0].unionByName(parts[1])


def p4_shares(spark, sf):
    """How often each channel and each model cuts."""
    parts = [cut_shares(v).withColumn("field_name", F.lit(name)) for name, v in _values(spark, sf)]
    return parts[0].unionByName(parts[1]).select("field_name", "source", "records", "cut", "share")


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares}
SQL: dict[str, str] = {}
