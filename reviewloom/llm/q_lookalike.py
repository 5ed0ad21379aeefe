"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from .lookalike import changed_ids, look_alike_groups_across, normalized

FIELDS = (("reviews", "text", "request_id"), ("analyses", "cleaned_text", "analysis_id"))


def _each(spark, sf, fn):
    parts = [fn(read_table(spark, f"{sf}/{table}.parquet"), record, text).withColumn("field_name", F.lit(text)) for table, text, record in FIELDS]
    return parts[0].unionByName(parts[1])


def p3_found(spark, sf):
    return _each(spark, sf, changed_ids).select("field_name", "record_id")


def p3_consistent(spark, sf):
    """Every text in its one consistent form."""
    return _each(spark, sf, normalized).select("field_name", "record_id", "consistent", "changed")


def p3_groups(spark, sf):
    """Texts written in several ways that look the same, within a field or across both."""
    return look_alike_groups_across([(text, read_table(spark, f"{sf}/{table}.parquet"), record, text) for table, text, record in FIELDS])


QUERIES = {"p3_found": p3_found, "p3_consistent": p3_consistent, "p3_groups": p3_groups}
SQL: dict[str, str] = {}
