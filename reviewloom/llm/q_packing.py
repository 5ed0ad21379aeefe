"""Queries of problems 8 and 9, which share the token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage, read_table
from .mixing import mix, share_report
from .packing import fill_report, pack
from .tokens import token_counts


def _specs(spark, sf):
    """A fixed table of a few rows, one a spec."""
    return [(r["spec_name"], r["capacity_tokens"]) for r in spark.read.parquet(f"{sf}/pack_specs.parquet").collect()]


def _targets(spark, sf):
    """A fixed table of a few rows, one a source that may be mixed."""
    table = spark.read.parquet(f"{sf}/mix_targets.parquet")
    return table, [(r["source"], r["target_share"], r["max_repeats"]) for r in table.collect()]


def _packed(spark, sf):
    specs = _specs(spark, sf)
    sizes = cut_lineage(token_counts(read_table(spark, f"{sf}/documents.parquet"), "doc_id", "text"))
    return pack(sizes, "record_id", "tokens", specs), specs


def p8_packed(spark, sf):
    packed, _ = _packed(spark, sf)
    return packed.withColumnRenamed("record_id", "doc_id")


def p8_fill(spark, sf):
    return fill_report(*_packed(spark, sf))


def _mixed(spark, sf):
    table, targets = _targets(spark, sf)
    documents = read_table(spark, f"{sf}/documents.parquet")
    listed = documents.where(F.col("source").isin([s for s, *_ in targets]))
    sizes = cut_lineage(token_counts(listed, "doc_id", "text", source="source"))
    return mix(sizes, targets), table


def p9_mix(spark, sf):
    mixed, _ = _mixed(spark, sf)
    return mixed.withColumnRenamed("record_id", "doc_id")


def p9_shares(spark, sf):
    return share_report(*_mixed(spark, sf))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
