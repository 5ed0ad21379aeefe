"""Queries of problem 6."""

from __future__ import annotations

from ..session import read_table
from .topn import top_n


def p6_found(spark, sf):
    items = read_table(spark, f"{sf}/keyword_items.parquet")
    return top_n(items, "product_id", "item_id", "score", n=5).select("product_id", "item_id")


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": """
        WITH items AS (
            SELECT product_id, item_id, max(score) AS score FROM keyword_items
            WHERE product_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1
            GROUP BY product_id, item_id)
        SELECT product_id, item_id FROM items
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, item_id) <= 5""",
}
