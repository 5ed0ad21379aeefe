"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import confusables


def at(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Project to the named columns under internal names; extra columns, whatever their names, are dropped here."""
    return df.select(*[(at(df, c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One Arrow hop, kept in one place so that every Python boundary of the subpackage is easy to find.

    Tasks find the driver's table of look-alike characters installed.
    """
    prototypes = confusables.shared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        confusables.install(prototypes.value)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def text_column(fn: Callable[[str], object], name: str, out: str, kind: pa.DataType):
    """A batch function that appends ``out`` = fn(name); null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(name)
            values = [None if v is None else fn(v) for v in batch.column(k).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != k] + [pa.array(values, kind)]
            names = [n for i, n in enumerate(batch.schema.names) if i != k] + [out]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def keyword_form(column: Column) -> Column:
    """Trim white space and lower-case; blank becomes null."""
    trimmed = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)
