"""Token counts by a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_batches, pick

#: A public sentence-piece model with byte fallback; it must lie at this path on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> sentencepiece.SentencePieceProcessor:
    """Loaded once a worker."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(df: DataFrame, record: str, text: str, path: str = MODEL, **extra: str) -> DataFrame:
    """``record_id, tokens`` and the ``extra`` columns; null and empty texts have 0 tokens. Whole texts, one Arrow hop."""
    rows = pick(df, record_id=record, text=text, **extra).withColumn("record_id", F.col("record_id").cast("bigint"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name not in ("record_id", "text")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            # In slices, so that few token lists are alive at a time.
            sizes = [len(ids) for k in range(0, len(texts), 256) for ids in model.encode(texts[k : k + 256], num_threads=1)]
            columns = [batch.column(0), pa.array(sizes, pa.int32()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["record_id", "tokens", *batch.schema.names[2:]])

    return map_batches(rows, run, ", ".join(["record_id bigint", "tokens int", *(f"{k} {v}" for k, v in kinds.items())]))
