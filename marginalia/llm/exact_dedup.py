"""Operator 13, exact dedup, in DataFrame operations only.

Rows are grouped by a 128-bit hash of their text together with the text itself: the hash deals
groups out and tells most texts apart, and the text's bytes, part of the key, decide. So two texts
that share a hash stay two groups. Every task sends one row for each of its distinct texts, whatever
number of copies it holds.

Rows find their group by the hash and the text's SHA-256, without the text. Groups of over one in
``HOT`` of all rows, of which there can be no more than ``HOT``, come by broadcast; the others by a
shuffle, in which no key has more than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise

#: Groups with more than one in so many rows are broadcast; there are fewer than this many.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised_text(text: Column) -> Column:
    """The text with A-Z (no other letters) in lower case; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # As many bytes as characters: ASCII alone, for which the plain function does the same, faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> list[Column]:
    """128 bits of the text: XXH64 under two seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(13), text)]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hashes=content_hash) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as the empty one. Of a
    group the row with the ``keep`` ("smallest" or "largest") id stays, null ids last: keep_id is null
    only where no row of the group has an id. Repeated rows, the same id and text, count in
    group_size and share one flag: nothing tells them apart (:func:`without_copies` keeps one of
    them). An empty table gives no rows. Further columns are ignored. ``hashes`` makes the two parts
    of the content hash.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised_text(F.col(text_col)).alias("text"))
    h1, h2 = hashes(F.col("text"))
    hashed = texts.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    best = (F.min if keep == "smallest" else F.max)("doc_id")
    groups = hashed.groupBy("h1", "h2", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialise(groups.select("h1", "h2", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups")
    rows = materialise(hashed.select("doc_id", "h1", "h2", F.sha2("text", 256).alias("text_sha256")), "exact-rows")

    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]  # one number
    key = ["h1", "h2", "text_sha256"]
    hot = F.broadcast(groups.filter(F.col("group_size") * HOT > total))  # fewer than HOT rows
    cold = rows.join(hot.select(*key), key, "left_anti").join(groups.filter(F.col("group_size") * HOT <= total), key)
    found = rows.join(hot, key).unionByName(cold)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts (see :func:`exact_duplicates`); all columns kept.

    Of repeated rows one stays, whichever.
    """
    did, sha, nth = free_names(docs, "did", "sha", "nth")
    kept = exact_duplicates(docs, id_col, text_col, keep).filter("kept").select(F.col("doc_id").alias(did), F.col("text_sha256").alias(sha)).distinct()
    keyed = docs.withColumn(sha, F.sha2(normalised_text(F.col(text_col)), 256)).withColumn(did, F.col(id_col))
    # Only rows that stay are compared: one of each text, and its repetitions.
    stay = keyed.join(kept.withColumnRenamed(did, nth), sha).filter(F.col(did).eqNullSafe(F.col(nth)))
    return stay.dropDuplicates([sha]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM texts JOIN groups USING (t)
"""
