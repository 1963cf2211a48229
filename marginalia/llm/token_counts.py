"""Operator 3, token counts: a map-side lookup in two tiers, without a shuffle of pre-tokens.

First tier: a broadcast hash table of the lengths (in tokens) of frequent pre-tokens, made from a
bounded sample of rows; it only saves work and never changes a count. Second tier: the worker's own
cache; what it misses is encoded. Each row is counted where it is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CACHE_CHARS, worker_bpe
from .common import small_batches

#: Rows of the sample, about, and entries of the table: 60,000 of 64 characters at most, a few MB.
SAMPLE_ROWS, TABLE = 3000, 60_000


def frequent_lengths(docs: DataFrame, text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> dict[str, int]:
    """Frequent pre-tokens of a hashed sample of ``SAMPLE_ROWS`` rows or so, with their token counts."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.select(F.col(text_col).cast("string").alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).limit(4 * SAMPLE_ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update((text or "").split(" ")[1:])
                if len(seen) > 20 * TABLE:
                    seen = Counter(dict(seen.most_common(10 * TABLE)))
        names = [k for k, _ in seen.most_common(TABLE) if k and len(k) <= CACHE_CHARS]
        lengths = [len(x) // 2 for x in worker_bpe(json_path, ranks_path).pieces(names)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int32())], ["name", "n"])

    return {r["name"]: r["n"] for r in sample.repartition(1).mapInArrow(count, "name string, n int").collect()}  # TABLE rows at most


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row's whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids each come back as
    they are. An empty table gives no rows. Further columns are ignored. Special strings inside a
    text are special tokens, as in the library's default.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, json_path, ranks_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(json_path, ranks_path)
        for batch in batches:
            n = bpe.counts(batch.column(2), shared.value)
            out = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(n > np.int64(limit))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("t"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())))])
    return rows.mapInArrow(count, schema)
