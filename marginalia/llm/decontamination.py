"""Operator 6, benchmark decontamination: a distributed positional inverted index.

Documents are indexed in blocks of bounded size. A block's index has, for each term, the ascending
positions at which it stands; positions run through the block's documents with gaps between them,
so a phrase never crosses documents. Indexes are stored, a row for each block, in a Parquet table.

A search brings a bounded set of phrases (windows of the benchmark's items) to every block. Phrases
are looked up from their rarest term, rarity being counted over all blocks: its list, shifted by the
term's offset, gives candidate starts, which are intersected with the shifted lists of the further
terms, rarest first, until none is left or all terms agree. The same lists answer proximity
searches (:func:`proximity_matches`): all terms of a set within a span of words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialise, release_memory, small_batches

#: Words of a document or an item, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a window.
WIDTH = 10
#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Words of items that one search brings to the blocks; more items are searched in several rounds.
ROUND_WORDS = 1_000_000
#: Positions left free between documents: more than any window or proximity span.
GAP = 64

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype="<i4").tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<i4")


INDEX = T.StructType([
    T.StructField("block", T.StringType()), T.StructField("n_docs", T.IntegerType()), T.StructField("lengths", T.BinaryType()), T.StructField("terms", T.StringType()),
    T.StructField("ends", T.BinaryType()), T.StructField("steps", T.BinaryType())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs``: a row for each block.

    block names it; doc_ids and lengths (words) list its documents in order; terms its terms, joined by newlines;
    ends where each term's list ends; steps the lists in a row, each position as its distance from
    the one before it in its list.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), *INDEX.fields])

    def block(ids: list[pa.Array], texts: list[list[str]]) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        starts = np.cumsum(lengths + GAP) - (lengths + GAP)
        positions = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(codes))
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(flat.dictionary)))
        listed = positions[order]
        steps = np.diff(listed, prepend=0)
        first = (ends - np.diff(ends, prepend=0))[:]
        steps[first] = listed[first]
        names = pa.concat_arrays(ids)
        terms = "\n".join(flat.dictionary.to_pylist())
        out = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([uuid.uuid4().hex]), pa.array([len(texts)], pa.int32())]
        out += [pa.array([_pack(lengths)], pa.binary()), pa.array([terms], pa.string()), pa.array([_pack(ends)], pa.binary()), pa.array([_pack(steps)], pa.binary())]
        return pa.RecordBatch.from_arrays(out, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            start = 0
            for k, text in enumerate(b.column(1).to_pylist()):
                texts.append(words(text))
                held += len(text or "")
                if held >= BLOCK_BYTES:
                    ids.append(b.column(0).slice(start, k + 1 - start))
                    yield block(ids, texts)
                    ids, texts, held, start = [], [], 0, k + 1
            if start < b.num_rows:
                ids.append(b.column(0).slice(start))
        if texts:
            yield block(ids, texts)
        ids, texts = [], []
        release_memory()

    return materialise(rows.mapInArrow(run, schema), "index")


class Block:
    """A block's lists, for a set of terms."""

    def __init__(self, row: dict, wanted: dict[str, int]):
        self.lengths = _unpack(row["lengths"]).astype(np.int64)
        self.starts = np.cumsum(self.lengths + GAP) - (self.lengths + GAP)
        ends = _unpack(row["ends"]).astype(np.int64)
        begins = ends - np.diff(ends, prepend=0)
        steps = _unpack(row["steps"])
        self.lists: dict[int, np.ndarray] = {}
        self.present = np.zeros(len(wanted), dtype=bool)
        for k, term in enumerate(row["terms"].split("\n") if len(ends) else ()):
            w = wanted.get(term)
            if w is not None:
                self.lists[w] = np.cumsum(steps[begins[k] : ends[k]])
                self.present[w] = True

    def phrase(self, terms: list[int], order: list[int]) -> np.ndarray:
        """Starts of the phrase ``terms``; ``order``: its places, rarest term first."""
        found = self.lists[terms[order[0]]] - order[0]
        for place in order[1:]:
            if not len(found):
                break
            # A start stays if it is on the list of this term, shifted by the term's place.
            other = self.lists[terms[place]]
            at = np.searchsorted(other, found + place)
            found = found[other[np.minimum(at, len(other) - 1)] == found + place]
        return found

    def near(self, terms: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, stops): places of a term from which on all ``terms`` stand within ``span`` words; stops exclusive."""
        lists = [self.lists.get(t, np.zeros(0, dtype=np.int64)) for t in set(terms)]
        rarest = min(lists, key=len)
        if not len(rarest):
            return rarest, rarest
        starts = np.unique(np.concatenate(lists))
        at = np.searchsorted(rarest, starts)  # the rarest term must follow soon
        starts = starts[(at < len(rarest)) & (rarest[np.minimum(at, len(rarest) - 1)] - starts < span)]
        stops = starts + 1
        for other in lists:
            at = np.searchsorted(other, starts)
            ok = at < len(other)
            starts, stops, at = starts[ok], stops[ok], at[ok]
            stops = np.maximum(stops, other[at] + 1)
        ok = stops - starts <= span
        return starts[ok], stops[ok]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def term_counts(index: DataFrame, wanted: dict[str, int]) -> np.ndarray:
    """How often each wanted term stands in all blocks; summed by Spark, a row a wanted term at most."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        for b in batches:
            for terms, ends in zip(b["terms"], b["ends"]):
                sizes = np.diff(_unpack(ends), prepend=0)
                for term, n in zip(terms.split("\n"), sizes.tolist()):
                    w = shared.value.get(term)
                    if w is not None:
                        total[w] += n
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    counts = index.select("terms", "ends").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), dtype=np.int64)
    for r in counts.collect():
        out[r["term"]] = r["n"]
    return out


def _windows(item_words: list[str]) -> list[tuple[str, ...]]:
    if not item_words:
        return []
    n = max(1, len(item_words) - WIDTH + 1)
    return [tuple(item_words[k : k + WIDTH]) for k in range(n)]


def _rounds(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items as (id, text), in rounds of about ``ROUND_WORDS`` words; only one round is held."""
    held, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        held.append((r["i"], r["t"]))
        n += len(r["t"]) // 4
        if n >= ROUND_WORDS:
            yield held
            held, n = [], 0
    yield held


def _search(index: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """Each document of ``index`` with the spans of words that windows of ``items`` hit, and which items."""
    phrases: dict[tuple[str, ...], list[int]] = {}
    names = sorted({i for i, _ in items})
    place = {name: k for k, name in enumerate(names)}
    for name, text in items:
        for w in _windows(words(text)):
            phrases.setdefault(w, []).append(place[name])
    wanted = {t: k for k, t in enumerate(sorted({t for p in phrases for t in p}))}
    counts = term_counts(index, wanted)
    plan = []
    for p, owners in phrases.items():
        terms = [wanted[t] for t in p]
        order = sorted(range(len(terms)), key=lambda k: (counts[terms[k]], k))
        if counts[terms[order[0]]]:  # a window with a term that no document has can't occur
            plan.append((terms, order, sorted(set(owners))))
    every = np.zeros((len(plan), WIDTH), dtype=np.int32)  # each phrase's terms; a short one's first stands again
    for k, (terms, _, _) in enumerate(plan):
        every[k] = terms + terms[:1] * (WIDTH - len(terms))
    shared = index.sparkSession.sparkContext.broadcast((wanted, plan, every, names))
    id_kind = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", id_kind), T.StructField("block", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("stops", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, plan, every, names = shared.value
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in ("block", "lengths", "terms", "ends", "steps")}
                ids = b.column("doc_ids")[k].values
                block = Block(row, wanted)
                at, size, owner = [], [], []
                for p in np.flatnonzero(block.present[every].all(axis=1)).tolist():  # all its terms are in this block
                    terms, order, owners = plan[p]
                    found = block.phrase(terms, order)
                    for o in owners if len(found) else ():
                        at.append(found)
                        size.append(np.full(len(found), len(terms)))
                        owner.append(np.full(len(found), o))
                n = len(block.lengths)
                starts, stops, hit = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                if at:
                    at, size, owner = np.concatenate(at), np.concatenate(size), np.concatenate(owner)
                    doc = block.document(at)
                    begin = at - block.starts[doc]
                    order = np.lexsort((size, begin, doc))
                    for d, part in zip(*_split(doc[order], order)):
                        starts[d], stops[d] = _merged(begin[part], begin[part] + size[part])
                        hit[d] = [names[o] for o in np.unique(owner[part]).tolist()]
                out = [ids, pa.array([f"{row['block']}:{d}" for d in range(n)]), pa.array(block.lengths), *(pa.array(x, pa.list_(pa.int32())) for x in (starts, stops)), pa.array(hit, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, schema.names)
        release_memory()

    return index.mapInArrow(run, schema)


def proximity_matches(index: DataFrame, term_sets: list[list[str]], span: int) -> DataFrame:
    """(doc_id, query, start, stop): where all terms of a set stand within ``span`` words of a document.

    ``index`` is of :func:`build_index`; ``query`` numbers the sets, which are stated by the caller and
    go to every block. A row for each word number ``start`` at which a term of the set stands and all
    others (each once) follow before start + span; stop is the word after the last of them. Terms are
    words in the sense of :func:`words`. A set without terms matches nothing; ``span`` is ``GAP`` at most.
    """
    if not 1 <= span <= GAP:
        raise ValueError(f"a span has 1 to {GAP} words")
    sets = [sorted({w for t in terms for w in words(t)}) for terms in term_sets]
    wanted = {t: k for k, t in enumerate(sorted({t for s in sets for t in s}))}
    shared = index.sparkSession.sparkContext.broadcast((wanted, [[wanted[t] for t in s] for s in sets]))
    kinds = [T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType), *(T.StructField(n, T.LongType()) for n in ("query", "start", "stop"))]
    schema = T.StructType(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sets = shared.value
        for b in batches:
            for k in range(b.num_rows):
                block = Block({n: b.column(n)[k].as_py() for n in ("lengths", "terms", "ends", "steps")}, wanted)
                for q, terms in enumerate(sets):
                    starts, stops = block.near(terms, span) if terms else (np.zeros(0, dtype=np.int64),) * 2
                    doc = block.document(starts)
                    base = block.starts[doc]
                    out = [b.column("doc_ids")[k].values.take(pa.array(doc)), pa.array(np.full(len(doc), q)), pa.array(starts - base), pa.array(stops - base)]
                    yield pa.RecordBatch.from_arrays(out, schema.names)

    return index.mapInArrow(run, schema)


def _split(sorted_keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    keys, first = np.unique(sorted_keys, return_index=True)
    return keys.tolist(), np.split(rows, first[1:])


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Intervals, sorted by start, as disjoint ones."""
    reach = np.maximum.accumulate(stops)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    return starts[fresh].tolist(), reach[last].tolist()


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, starts, stops (disjoint spans of hit words, stops exclusive) and items of every row.

    Null texts have no words; documents and items without words hit nothing. Items with the same id
    count as one. Repeated rows each come back; null ids stay null. Empty tables give no rows, or no
    hits. Further columns are ignored.
    """
    index = build_index(docs, id_col, text_col)
    found = None
    for items in _rounds(benchmark, item_col, item_text_col):
        part = _search(index, items)
        found = part if found is None else found.union(part)
        several = found is not part
    if not several:
        return found.drop("block")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = []
            for s, e in zip(b["starts"], b["stops"]):
                s, e = np.array(s, dtype=int), np.array(e, dtype=int)
                order = np.argsort(s, kind="stable")
                spans.append(_merged(s[order], e[order]) if len(s) else ([], []))
            yield b.assign(starts=[s for s, _ in spans], stops=[e for _, e in spans])

    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  a row a round
    # Blocks and places in them tell documents apart.
    once = found.groupBy("block", "doc_id", "n_words").agg(flat("starts"), flat("stops"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return once.mapInPandas(merge, once.schema).drop("block")


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = contamination(docs, benchmark)
    hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs; all columns kept."""
    row = F.struct(F.col(id_col).cast("string").alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    (name,) = free_names(docs, "row")
    keyed = docs.withColumn(name, F.xxhash64(row))
    found = contamination(keyed, benchmark, name, text_col)
    bad = found.filter(F.size("starts") > 0).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(bad, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.n, p.k, i.item_id FROM places p JOIN windows i USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, n)) AS j FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
