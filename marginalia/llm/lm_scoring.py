"""Operator 8, LM scoring: a bigram model with deleted interpolation.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the
context's frequency c(h). The weights of each bucket are learned by expectation-maximisation on the
tokens of a deleted fold of the training documents, with that fold's own counts taken away.

Counts are exchanged in two shuffles instead of a join of every token:

1. Documents are gathered in batches of bounded size where they are read. A batch is stored as its
   word numbers. From these it asks for the counts of its distinct words and word pairs; the request
   carries how often the batch itself saw them. A word is asked for once a batch, however frequent.
2. Requests are dealt by key. A part sums what all batches saw and answers each of them in the
   order it asked.
3. Answers meet their batch again, where the counts are laid along its tokens.

Words and pairs are named by 64-bit hashes; counts over the corpus have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, materialise, release_memory, small_batches

#: Bytes of text in a batch, about (a longer document is a batch of its own), and for each part.
BATCH_BYTES, PART_BYTES = 5 << 20, 8 << 20
#: Buckets: the base-2 logarithm of the context's count, 0 for none.
BUCKETS = 20
#: Log ratios to the uniform probability are kept in steps of 1 / STEP nat, in LEVELS levels.
STEP, LEVELS, ZERO_AT = 4, 160, 48
#: Rounds of expectation-maximisation, and the least weight of the uniform part.
EM_ROUNDS, FLOOR = 60, 1e-4
#: The hash that names the end of a document, and the one that stands before its first word.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _pack(values: np.ndarray) -> bytes:
    """Numbers of one width, their bytes transposed, compressed."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pairs(codes: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair keys ascending, the place in them of each token's pair, each token's context or len(keys))."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(lengths) - lengths] = len(keys)
    pair, place = np.unique(before.astype(np.int64) * len(keys) + codes, return_inverse=True)
    first, second = np.append(keys, START)[pair // len(keys)], keys[pair % len(keys)]
    named = (first * np.uint64(0xFF51AFD7ED558CCD) ^ (second >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) + second
    order = np.argsort(named)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return named[order], rank[place.ravel()], before


def _tokenise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word keys ascending, a number into them for each token, tokens of each text); the last token is the end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    digest = xxhash.xxh3_64_intdigest
    keys = np.array([digest(w) for w in names] + [int(END)], dtype=np.uint64)
    blank = np.array([not w for w in names], dtype=bool)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if blank.any():  # what stands before a leading blank or after a trailing one
        real = ~blank[codes]
        codes, text = codes[real], text[real]
    lengths = np.bincount(text, minlength=len(texts)) + 1
    tokens = np.full(int(lengths.sum()), len(names), dtype=np.int64)
    tokens[np.arange(len(codes)) + text] = codes
    used, tokens = np.unique(tokens, return_inverse=True)
    order = np.argsort(keys[used])
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order))
    return keys[used][order], rank[tokens.ravel()], lengths


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _bucket(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(contexts + 1.0)), BUCKETS - 1).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(BUCKETS, 3) weights of the pair, word and uniform part from a histogram of held-out tokens.

    A cell is (bucket * LEVELS + level of the pair's probability) * LEVELS + level of the word's;
    level 0 is probability 0.
    """
    bucket, two, one = cells // LEVELS**2, cells // LEVELS % LEVELS, cells % LEVELS
    ratio = lambda level: np.where(level > 0, np.exp((level - ZERO_AT) / STEP), 0.0)
    parts = np.stack([ratio(two), ratio(one), np.ones(len(cells))], axis=1)
    overall = np.array([0.4, 0.4, 0.2])

    def em(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        for _ in range(EM_ROUNDS):
            post = parts[rows] * w
            post *= (counts[rows] / post.sum(axis=1))[:, None]
            w = np.maximum(post.sum(axis=0) / counts[rows].sum(), [0, 0, FLOOR])
            w = w / w.sum()
        return w

    if len(cells):
        overall = em(np.arange(len(cells)), overall)
    out = np.tile(overall, (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        if len(rows):
            out[b] = em(rows, np.array([0.4, 0.4, 0.2]))
    out[0] = np.array([0, out[0, 1] + out[0, 0], out[0, 2]])  # no context was seen: nothing to say about pairs
    return out


def _batches(docs: DataFrame) -> DataFrame:
    """A row for each batch: its documents, their lengths (a), tokens (b) and folds (c), and its words (d)."""
    id_kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("batch", T.StringType()), T.StructField("doc_ids", T.ArrayType(id_kind)), *(T.StructField(n, T.BinaryType()) for n in "abcd")])

    def row(name: str, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, texts, fold = (pa.concat_arrays([h.column(k) for h in held]) for k in range(3))
        keys, codes, lengths = _tokenise(texts)
        blobs = [_pack(lengths.astype("<i4")), _pack(codes.astype("<i4")), _pack(fold.to_numpy(zero_copy_only=False).astype(np.int8)), _pack(np.diff(keys, prepend=np.uint64(0)))]
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([name]), listed, *(pa.array([b], pa.binary()) for b in blobs)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
            if size >= BATCH_BYTES:
                yield row(f"{me}-{k}", held)
                k, held, size = k + 1, [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield row(f"{me}-{k}", held)
        held.clear()
        release_memory()

    return docs.mapInArrow(run, schema)


def _requests(stored: DataFrame, parts: int) -> DataFrame:
    """What each batch asks of each part: keys (a), how often it saw them (b), and that in the deleted fold (c)."""
    names = ("batch", "ord", "part", "a", "b", "c")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lengths, codes, fold, steps = (_unpack(b.column(n)[k].as_py(), t) for n, t in zip("abcd", ("<i4", "<i4", "i1", "<u8")))
                keys = np.cumsum(steps, dtype=np.uint64)
                each = np.repeat(fold, lengths)
                pair_keys, places, _ = _pairs(codes.astype(np.int64), lengths.astype(np.int64), keys)
                for order, asked, at in ((1, keys, codes), (2, pair_keys, places)):
                    seen = np.bincount(at[each != 2], minlength=len(asked))
                    dev = np.bincount(at[each == 1], minlength=len(asked))
                    cuts = np.searchsorted(_part(asked, parts), np.arange(parts + 1)).tolist()
                    rows = [
                        (b.column("batch")[k].as_py(), order, p, _pack(np.diff(asked[i:j], prepend=np.uint64(0))), _pack(seen[i:j].astype("<u4")), _pack(dev[i:j].astype("<u4")))
                        for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], list(names))

    return stored.select("batch", *"abcd").mapInArrow(run, "batch string, ord int, part int, a binary, b binary, c binary")


def _answer(asked: pa.Table) -> pa.Table:
    """Sums over all batches for one part, in the order of each batch's request; totals on a row of their own."""
    names = asked.column("batch").to_pylist()
    keys = [np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in asked.column("a").to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    place, ends = place.ravel(), np.cumsum([len(k) for k in keys])
    sums = []
    for column in ("b", "c"):
        given = np.concatenate([_unpack(x, "<u4") for x in asked.column(column).to_pylist()])
        sums.append(np.bincount(place, weights=given, minlength=len(every)).astype("<i8"))
    rows = [(n, *(_pack(s[place[e - len(k) : e]]) for s in sums), None, None, None) for n, k, e in zip(names, keys, ends)]
    rows.append((None, None, None, int((sums[0] > 0).sum()), int(sums[0].sum(dtype=np.int64)), int(sums[1].sum(dtype=np.int64))))
    columns = list(zip(*rows))
    same = [pa.array([asked.column(n)[0].as_py()] * len(rows), pa.int32()) for n in ("ord", "part")]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([*same, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["ord", "part", "batch", "seen", "dev", "n_kinds", "n_seen", "n_dev"])


LAID = ("doc_ids", "lengths", "fold", "context", "word", "pair", "cells", "counts")


def _laid_out(stored: pa.Table, answers: pa.Table, totals: tuple[int, int, int]) -> pa.Table:
    """A batch's counts along its tokens, and the histogram of its deleted fold's tokens."""
    n_kinds, n_all, n_dev = totals
    row = {n: stored.column(n)[0] for n in ("doc_ids", "a", "b", "c", "d")}
    lengths, codes, fold = (_unpack(row[n].as_py(), k) for n, k in (("a", "<i4"), ("b", "<i4"), ("c", "i1")))
    keys = np.cumsum(_unpack(row["d"].as_py(), "<u8"), dtype=np.uint64)
    answers = sorted(answers.select(["ord", "part", "seen", "dev"]).to_pylist(), key=lambda r: (r["ord"], r["part"]))
    count = {(o, n): np.concatenate([_unpack(r[n], "<i8") for r in answers if r["ord"] == o]) for o in (1, 2) for n in ("seen", "dev")}
    _, places, before = _pairs(codes.astype(np.int64), lengths.astype(np.int64), keys)
    end = codes[np.cumsum(lengths) - 1][0]
    dev = np.flatnonzero(np.repeat(fold, lengths) == 1)

    def along(n: str, at: np.ndarray | slice) -> tuple[np.ndarray, ...]:
        word = count[1, n]
        return np.append(word, word[end])[before[at]], word[codes[at]], count[2, n][places[at]]  # there are as many starts as ends

    h, w, p = (a.astype(np.int64) - b for a, b in zip(along("seen", dev), along("dev", dev)))
    two = np.where(p > 0, p / np.maximum(h, 1), 0) * (n_kinds + 1.0)
    one = np.where(w > 0, w, 0) / max(1, n_all - n_dev) * (n_kinds + 1.0)
    level = [np.zeros(len(h), dtype=np.int64) for _ in range(2)]
    for x, at in zip((two, one), level):
        at[x > 0] = np.clip(np.round(np.log(x[x > 0]) * STEP) + ZERO_AT, 1, LEVELS - 1)
    cells, counts = np.unique((_bucket(h) * LEVELS + level[0]) * LEVELS + level[1], return_counts=True)
    blobs = [_pack(lengths), _pack(fold), *map(_pack, along("seen", slice(None)))]
    ids = row["doc_ids"].values
    out = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in blobs)]
    out += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (cells, counts)]
    return pa.Table.from_arrays(out, names=list(LAID))


def _scores(batches: Iterator[pa.RecordBatch], totals: tuple[int, int, int], weights: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    n_kinds, n_all, _ = totals
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(n)[k] for n in LAID[:6]}
            lengths, fold = _unpack(row["lengths"].as_py(), "<i4").astype(np.int64), _unpack(row["fold"].as_py(), "i1")
            h, w, p = (_unpack(row[n].as_py(), "<i8").astype(np.float64) for n in ("context", "word", "pair"))
            mix = weights[_bucket(h)]
            likely = mix[:, 0] * p / np.maximum(h, 1) + mix[:, 1] * w / max(1, n_all) + mix[:, 2] / (n_kinds + 1)
            starts = np.cumsum(lengths) - lengths
            base = np.add.reduceat(np.log10((w + 1) / (n_all + n_kinds + 1)), starts)
            score, known = np.add.reduceat(np.log10(likely), starts), np.add.reduceat((w > 0).astype(np.int64), starts)
            out = [row["doc_ids"].values, pa.array(fold == 2), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n_all)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    ``held_out`` rows (default: crc32 of the id modulo 7 is 2) teach nothing; of the others, those
    that are ``deleted`` (default: modulo 7 is 3) set the weights. A null text is empty: it has the
    end token alone. Null ids count as the empty text for the folds. Repeated rows each come back
    and each teach. Without training rows every token is as likely as any: probability 1. An empty
    table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = crc32_mod(F.col(id_col), 7)
    held_out = fold == 2 if held_out is None else held_out
    deleted = fold == 3 if deleted is None else deleted
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.when(held_out, 2).when(deleted, 1).otherwise(0).alias("fold"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    stored = materialise(_batches(rows), "lm-batches")

    answers = _requests(stored, max(1, -(-size // PART_BYTES))).groupBy("ord", "part")
    answers = materialise(answers.applyInArrow(_answer, "ord int, part int, batch string, seen binary, dev binary, n_kinds long, n_seen long, n_dev long"), "lm-answers")
    sums = answers.filter("batch is null and ord = 1").agg(F.sum("n_kinds"), F.sum("n_seen"), F.sum("n_dev")).first()
    totals = tuple(int(x or 0) for x in sums)

    texts = stored.groupBy("batch")
    id_kind = rows.schema["doc_id"].dataType
    kinds = [T.ArrayType(id_kind), *[T.BinaryType()] * 5, *[T.ArrayType(T.LongType())] * 2]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(LAID, kinds)])
    told = answers.filter("batch is not null").select("batch", "ord", "part", "seen", "dev").groupBy("batch")
    laid = materialise(texts.cogroup(told).applyInArrow(lambda left, right: _laid_out(left, right, totals), schema), "lm-laid")

    cells = laid.select(F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy("x.cells").agg(F.sum("x.counts").alias("n")).collect()  # BUCKETS * LEVELS^2 at most
    cells = np.array(sorted((r["cells"], r["n"]) for r in cells), dtype=np.int64).reshape(-1, 2)
    weights = learn_weights(cells[:, 0], cells[:, 1].astype(float))
    if not totals[1]:  # nothing was seen: the uniform part alone says something
        weights[:] = 0, 0, 1
    fields = [("doc_id", id_kind), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    names = [n for n, _ in fields]
    scored = laid.select(*LAID[:6]).mapInArrow(lambda batches: _scores(batches, totals, weights, names), T.StructType([T.StructField(n, k) for n, k in fields]))
    return scored
