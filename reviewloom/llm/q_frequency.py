"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from .frequency import map_key_counts, term_counts, with_mark


def _marked(spark, sf, occurrence):
    items = read_table(spark, f"{sf}/keyword_items.parquet")
    profiles = read_table(spark, f"{sf}/product_profiles.parquet")
    parts = (("keyword", term_counts(items, "keyword", "analysis_id", occurrence)), ("keyword_counts", map_key_counts(profiles, "keyword_counts")))
    tables = [with_mark(*x).select(F.lit(name).alias("field_name"), F.col("term").alias("keyword"), "occurrences", "records", "mark") for name, x in parts]
    return tables[0].unionByName(tables[1])


def p7_found(spark, sf):
    return _marked(spark, sf, None).where(F.col("mark").isNotNull()).select("field_name", "keyword", "mark")


def p7_counts(spark, sf):
    return _marked(spark, sf, "item_id")


QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}

_COUNTS = r"""
    WITH once AS (
        SELECT DISTINCT item_id, analysis_id, nullif(lower(regexp_replace(keyword, '^\s+|\s+$', '', 'g')), '') AS term FROM keyword_items),
    entries AS (
        SELECT row_number() OVER () AS record, map_entries(keyword_counts) AS e FROM product_profiles),
    keys AS (
        SELECT record, nullif(lower(regexp_replace(x.key, '^\s+|\s+$', '', 'g')), '') AS term, coalesce(x.value, 0) AS n
        FROM (SELECT record, unnest(e) AS x FROM entries)),
    counts AS (
        SELECT 'keyword' AS field_name, term AS keyword, count(*)::BIGINT AS occurrences, count(DISTINCT analysis_id)::BIGINT AS records,
            (SELECT count(DISTINCT analysis_id) FROM keyword_items) AS total FROM once WHERE term IS NOT NULL GROUP BY term
        UNION ALL
        SELECT 'keyword_counts', term, sum(n)::BIGINT, count(DISTINCT record)::BIGINT, (SELECT count(*) FROM product_profiles)
        FROM keys WHERE term IS NOT NULL GROUP BY term),
    marked AS (
        SELECT field_name, keyword, occurrences, records,
            CASE WHEN records < 3 THEN 'rare' WHEN records > total * 0.05 THEN 'common' END AS mark FROM counts)
"""
SQL = {
    "p7_found": _COUNTS + "SELECT field_name, keyword, mark FROM marked WHERE mark IS NOT NULL",
    "p7_counts": _COUNTS + "SELECT field_name, keyword, occurrences, records, mark FROM marked",
}
