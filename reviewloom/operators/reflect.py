"""Reflection on keywords: what to remove, what to add, and when enough is enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keywords import by_score, minimum_keywords, split_by_score

THRESHOLD, ROUNDS = 0.7, 5


def apply_delta(ks: Column, remove: Column, add: Column) -> Column:
    """Without the removed keywords, then the added ones that aren't among the rest; repeats within ``add`` stay."""
    rest = F.filter(ks, lambda k: ~F.array_contains(F.coalesce(remove, F.array().cast("array<string>")), k["keyword"]))
    names = F.transform(rest, lambda k: k["keyword"])
    return F.concat(rest, F.filter(F.coalesce(add, F.array().cast("array<struct<reasoning:string,keyword:string,score:double>>")), lambda k: ~F.array_contains(names, k["keyword"])))


def fingerprints(issues: Column) -> Column:
    """The distinct ``type:detail`` of issues of high severity, the detail's first 30 characters."""
    high = F.filter(issues, lambda i: i["severity"] == "high")
    return F.array_sort(F.array_distinct(F.transform(high, lambda i: F.concat_ws(":", i["type"], F.substring(i["detail"], 1, 30)))))


def reflect_once(ks: Column, proposed: Column, text: Column, threshold: float = THRESHOLD) -> Column:
    """One round by rule: low scores go; proposals come in if new, high enough and in the text.

    A list that is long enough for its text after the low scores are gone passes unchanged in order; else it is sorted.
    """
    kept = split_by_score(ks, threshold)["kept"]
    names = F.transform(kept, lambda k: k["keyword"])
    good = F.filter(proposed, lambda k: ~F.array_contains(names, k["keyword"]) & (F.coalesce(k["score"], F.lit(1.0)) >= threshold) & text.contains(k["keyword"]))
    enough = F.size(kept) >= minimum_keywords(text)
    return F.when(enough, kept).otherwise(by_score(F.concat(kept, F.array_distinct(good))))


def needs_reflection(ks: Column, text: Column, threshold: float = THRESHOLD) -> Column:
    """The cheap check that stands before any model call: only rows that fail it go to Python."""
    return F.size(split_by_score(ks, threshold)["kept"]) < minimum_keywords(text)
