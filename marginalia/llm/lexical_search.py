"""Operator 12, ranked lexical search: Block-Max WAND over a compressed index of segments.

The index is cut by documents: a task turns the texts it reads into segments of a bounded size, so
building it shuffles nothing, and a very frequent term's postings are spread over all segments. A
segment's documents are numbered by rising id. A term's postings in a segment are cut into blocks of
``BLOCK``: numbers as gaps and frequencies, in bytes of seven bits. Beside the bytes stand, for each
block, its last document, where its bytes end, and its maximum impact (the score of a posting but for
the term's weight).

A search meets the index in pairs of a block of items and a segment. For an item, the block limits of
all its terms cut the segment into ranges of documents that lie in one block of each term; the sum of
the blocks' maxima bounds the score of every document of a range. The ranges of the highest bounds
are read first, for a threshold; then a pointer moves shallowly, over limits and maxima alone, to the
next ranges whose bound reaches the threshold, and only their blocks are decompressed. So the item's
best documents of the segment are exact, and so are the best of all segments' best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release_memory, small_batches

#: Postings in a block; bytes of text in a segment (one longer text is a segment of its own).
BLOCK, SEGMENT = 128, 16 << 20
#: Items searched together, about; ranges read for a first threshold, and then at a time.
ITEMS, FIRST, NEXT = 256, 8, 32
#: All ASCII but letters and digits parts terms; A-Z become lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "segment long, term string, n int, lasts array<int>, tops array<long>, ends array<int>, data binary, ids array<long>, norms array<long>"
_ARROW = pa.schema([
    ("segment", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("lasts", pa.list_(pa.int32())), ("tops", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
    ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64()))])


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, repeats included."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@F.pandas_udf(T.LongType())
def _term_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([len(terms_of(t)) for t in texts], dtype="int64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _distinct_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[t.decode("utf-8", "replace") for t in set(terms_of(x))] for x in texts], dtype=object)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value's bytes end): seven bits a byte, the lowest first, all but a value's last with the top bit."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= (1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size)[has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The values of :func:`packed` bytes."""
    last = data < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts) if len(data) else np.zeros(0, dtype=np.int64)


class Segment:
    """Gathers the postings of documents until they are enough for a segment."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total = docs, total
        self.ids, self.norms, self.bytes = [], [], 0
        self.names: dict[bytes, int] = {}
        self.term, self.doc, self.tf = [], [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = terms_of(text)
        if not words:
            return
        counts = Counter(words)
        names = self.names
        self.term.extend([names.setdefault(t, len(names)) for t in counts])
        self.doc.extend(repeat(len(self.ids), len(counts)))
        self.tf.extend(counts.values())
        self.ids.append(doc_id)
        # Fixed rule of the contract: the length's share of the score.
        self.norms.append(100 - 90 + (90 * len(words) * self.docs) // self.total)
        self.bytes += sum(map(len, words)) + len(words)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """The index rows: one for each term, and one under the empty term with the documents' ids and norms."""
        if not self.ids:
            return
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(len(by_id), dtype=np.int64)
        number[by_id] = np.arange(len(by_id))
        norms = np.array(self.norms, dtype=np.int64)[by_id]
        names = sorted(self.names)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.names[t] for t in names]] = np.arange(len(names))
        term, doc, tf = rank[self.term], number[self.doc], np.array(self.tf, dtype=np.int64)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        n = np.bincount(term, minlength=len(names))
        first = np.cumsum(n) - n
        place = np.arange(len(doc)) - np.repeat(first, n)
        starts = np.flatnonzero(place % BLOCK == 0)
        blocks = -(-n // BLOCK)
        last = np.append(starts[1:], len(doc)) - 1
        gaps = np.where(place % BLOCK == 0, doc, doc - np.roll(doc, 1))
        tops = np.maximum.reduceat((10**9 * tf) // (1000 * tf + 8 * norms[doc]), starts)
        data, ends = packed(np.stack([gaps, tf - 1], axis=1).ravel())
        ends = ends[1::2]  # of each posting
        list_ends = ends[first + n - 1]
        list_starts = np.append(0, list_ends[:-1])
        block_ends = (ends[last] - np.repeat(list_starts, blocks)).astype(np.int32)
        offsets = pa.array(np.append(0, np.cumsum(blocks)).astype(np.int32))
        none = pa.nulls(len(names), pa.list_(pa.int64()))
        bits = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.append(0, list_ends).astype(np.int32)), pa.py_buffer(data)])
        yield pa.record_batch([
            pa.array(np.full(len(names), segment)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(doc[last].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(tops)), pa.ListArray.from_arrays(offsets, pa.array(block_ends)), bits, none, none], schema=_ARROW)
        yield pa.record_batch([
            pa.array([segment]), pa.array([""]), pa.array([len(by_id)], pa.int32()), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int32())),
            pa.array([b""], pa.binary()), pa.array([[self.ids[i] for i in by_id]], pa.list_(pa.int64())), pa.array([norms.tolist()], pa.list_(pa.int64()))], schema=_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(stored index, documents with a term, all their terms); a null id comes after all others."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = _term_count("text")
    docs_n, total, size = rows.select(n.alias("n"), F.octet_length("text").alias("b")).agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.col("b").cast("long"))).first()
    total = total or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        segment = Segment(docs_n, total)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                segment.add(doc_id, text)
                if segment.bytes >= SEGMENT:
                    yield from segment.rows((part << 32) + made)
                    segment, made = Segment(docs_n, total), made + 1
        yield from segment.rows((part << 32) + made)
        release_memory()

    # Small pieces of input are read together, or segments would be tiny; nothing is shuffled.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // SEGMENT))
    index = materialise(rows.coalesce(tasks).mapInArrow(build, INDEX), "lexical-index")
    return index, docs_n, total


class Postings:
    """A term's postings in a segment; blocks are decompressed when they are asked for, once."""

    def __init__(self, weight: int, n: int, lasts, tops, ends, data: bytes, norms: np.ndarray):
        self.n, self.norms = n, norms
        self.lasts, self.tops, self.ends = np.asarray(lasts, dtype=np.int64), np.asarray(tops, dtype=np.int64) * weight, np.asarray(ends, dtype=np.int64)
        self.weight, self.data = weight, np.frombuffer(data, dtype=np.uint8)
        self.open = np.zeros(len(self.lasts), dtype=bool)
        self.docs = self.scores = None

    def read(self, blocks: np.ndarray) -> np.ndarray:
        """The places of the postings of ``blocks`` (rising) in ``docs`` and ``scores``."""
        if self.docs is None:
            self.docs, self.scores = np.empty(self.n, dtype=np.int64), np.empty(self.n, dtype=np.int64)
        shut = blocks[~self.open[blocks]]
        if len(shut):
            places = self._places(shut)
            begins = np.append(0, self.ends[:-1])[shut]
            values = unpacked(self.data[_ranges(begins, self.ends[shut] - begins)])
            gaps, tf = values[::2], values[1::2] + 1
            first = np.cumsum(self._sizes(shut)) - self._sizes(shut)
            run = np.cumsum(gaps)
            docs = run - np.repeat(run[first] - gaps[first], self._sizes(shut))
            self.docs[places] = docs
            self.scores[places] = self.weight * ((10**9 * tf) // (1000 * tf + 8 * self.norms[docs]))
            self.open[shut] = True
        return self._places(blocks)

    def _sizes(self, blocks: np.ndarray) -> np.ndarray:
        return np.minimum(self.n - blocks * BLOCK, BLOCK)

    def _places(self, blocks: np.ndarray) -> np.ndarray:
        return _ranges(blocks * BLOCK, self._sizes(blocks))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def best_documents(lists: list[Postings], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, scores) of the ``k`` highest scores above 0 of a segment, ties to the smaller number."""
    lists = [p for p in lists if p.weight > 0]
    if not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    limits = np.unique(np.concatenate([p.lasts for p in lists]))
    begins = np.append(0, limits[:-1] + 1)
    at = [np.searchsorted(p.lasts, limits) for p in lists]  # the block of each range
    bound = np.zeros(len(limits), dtype=np.int64)
    for p, block in zip(lists, at, strict=True):
        bound += np.append(p.tops, 0)[block]
    top, scores, left = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.ones(len(limits), dtype=bool)
    pick, step = np.sort(np.argsort(-bound, kind="stable")[:FIRST]), NEXT
    acc = np.zeros(docs, dtype=np.int64)
    while len(pick):
        left[pick] = False
        for p, block in zip(lists, at, strict=True):
            need = block[pick]
            need = need[need < len(p.lasts)]
            if len(need):
                places = p.read(need[np.append(True, need[1:] != need[:-1])])
                acc[p.docs[places]] += p.scores[places]
        seen = _ranges(begins[pick], limits[pick] + 1 - begins[pick])
        seen = seen[acc[seen] > 0]
        top, scores = np.concatenate([top, seen]), np.concatenate([scores, acc[seen]])
        acc[:] = 0
        keep = np.lexsort((top, -scores))[:k]
        top, scores = top[keep], scores[keep]
        if len(top) == k:
            alive = left & ((bound > scores[-1]) | ((bound == scores[-1]) & (begins < top[-1])))
        else:
            alive = left & (bound > 0)
        pick, step = np.flatnonzero(alive)[:step], step * 2
    return top, scores


def _search(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best documents of one segment for each item of a block of items."""
    head = group[group["term"] == ""].iloc[0]
    ids, norms = head["ids"], np.asarray(head["norms"], dtype=np.int64)
    wanted: dict = {}
    for row in group[group["term"] != ""].itertuples():
        postings = Postings(int(row.w), int(row.n), row.lasts, row.tops, row.ends, row.data, norms)
        for q in row.items_:
            wanted.setdefault(int(q), []).append(postings)
    out = []
    for q, lists in wanted.items():
        top, scores = best_documents(lists, len(norms), k)
        out += [(q, ids[i], int(s)) for i, s in zip(top.tolist(), scores.tolist(), strict=True)]
    return pd.DataFrame({"q": [o[0] for o in out], "doc_id": pd.array([None if pd.isna(o[1]) else int(o[1]) for o in out], dtype="Int64"), "score": [o[2] for o in out]})


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents with the highest scores above 0 of each item.

    Ties go to the smaller doc_id, a null one last. Null and empty texts have no terms, neither as
    documents nor as items; items that find nothing have no rows. Repeated rows of ``docs`` are
    documents of their own; rows of ``items`` with one item_id (null is one, too) are one item with
    the terms of all. Empty tables give no rows. Further columns are ignored.
    """
    index, docs_n, _ = build_index(docs, id_col, text_col)
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(_distinct_terms(F.col(item_text_col).cast("string"))).alias("term")).distinct()
    asked = materialise(asked, "lexical-asked")
    names = asked.select("item_id").distinct().withColumn("q", F.monotonically_increasing_id())
    names = materialise(names, "lexical-items")  # numbers hold once they are stored
    blocks = max(1, -(-names.count() // ITEMS))
    words = asked.select("term").distinct()
    df = index.join(words, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs_n + 2) / (2 * F.col("df") + 1)))
    weights = df.select("term", weight.alias("w"))
    numbered = asked.join(names, asked["item_id"].eqNullSafe(names["item_id"])).select("q", "term")
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    sent = numbered.join(weights, "term").groupBy("block", "term", "w").agg(F.collect_list("q").alias("items_"))  # a block's items
    heads = numbered.select("block").distinct().select("block", F.lit("").alias("term"), F.lit(0).cast("long").alias("w"), F.array().cast("array<long>").alias("items_"))
    met = index.join(sent.unionByName(heads), "term")
    found = met.groupBy("block", "segment").applyInPandas(lambda g: _search(g, k), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(names, "q").select("item_id", "rank", "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
size AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM postings GROUP BY t),
items AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark)),
weights AS (SELECT item_id, t, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM items JOIN df USING (t), size),
scores AS (
  SELECT item_id, r, doc_id, sum(weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * docs.n * nn) // ll))))::BIGINT AS score
  FROM weights JOIN postings USING (t) JOIN docs USING (r), size GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
