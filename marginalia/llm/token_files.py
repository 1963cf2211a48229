"""Operator 9, token-ID files: Re-Pair grammars over shards of ids, with random access.

Texts are ranged and sorted by id, encoded, and closed by an end id. A shard holds about
``SHARD_IDS`` ids of consecutive documents. Its frequent pairs of neighbouring symbols become
nonterminals (one rule each), until no pair occurs ``LEAST`` times. Many pairs are replaced at once:
in a pass all pairs are counted, and a pair is replaced where it is more frequent than both pairs
that overlap it; the most frequent one of all is replaced everywhere, so passes come to an end. Only
pairs that were frequent in the last pass, or that hold a nonterminal made by it, can be frequent in
the next, so that later passes touch few places. The file format is a Parquet row for each shard:

=============  ================================================================================
part, piece    the shard's place: parts in order, pieces in order inside a part
doc_ids        its documents
lengths        the number of ids of each document, 64-bit little-endian, zstandard
rules          the two symbols of each rule in order, 32-bit, zstandard; rule r is symbol 65536 + r
spans          the expansion length of each rule, 32-bit, zstandard
body           the remaining symbols, 32-bit, zstandard
=============  ================================================================================

The expansion lengths place every symbol of the body, so any range of ids is decoded from the
symbols that cover it and the rules that they reach (:func:`decode_range`, :func:`read_documents`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import worker_bpe
from .common import release_memory, shared_dir, small_batches

#: Ids in a shard, about; a single longer document is a shard of its own.
SHARD_IDS = 4_000_000
#: The first nonterminal; ids are below it.
FIRST_RULE = 1 << 16
#: How often a pair must occur to get a rule, and bits of the hash by which most rare pairs are told first.
LEAST, HASH_BITS = 8, 22
#: Bytes of text in a range of ids, about.
PART_BYTES = 32 << 20


def _alternate(at: np.ndarray) -> np.ndarray:
    """For ascending places, whether each is one of every second in its run of consecutive ones."""
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = np.diff(at) > 1
    order = np.arange(len(at))
    return (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, spans, body) of a sequence of ids: rules has a row (left, right) for each nonterminal."""
    symbols, found, n_rules = ids.astype(np.int32), [], 0
    at = np.arange(len(symbols) - 1, dtype=np.int32)  # where a pair may be frequent
    while len(at):
        left, right = symbols[at], symbols[at + 1]
        keys = (left.astype(np.int64) << 32) | right
        slots = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
        often = np.bincount(slots, minlength=1 << HASH_BITS)[slots] >= least
        # In a run of one symbol every second pair counts; the others may later.
        same = np.flatnonzero(often & (left == right))
        same = same[~_alternate(at[same])]
        often[same] = False
        waiting = at[same]
        at, coded = at[often], pa.array(keys[often]).dictionary_encode()
        pair, names = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        counts = np.bincount(pair, minlength=len(names))
        used = np.flatnonzero(counts >= least)
        if not len(used):
            break
        rank = np.zeros(len(names), dtype=np.int32)  # by count, ties by key; 0 for what is rare
        rank[used[np.lexsort((names[used], counts[used]))]] = np.arange(1, len(used) + 1)
        mine = rank[pair]
        at, pair, mine = at[mine > 0], pair[mine > 0], mine[mine > 0]
        ranks = np.zeros(len(symbols) + 1, dtype=np.int32)
        ranks[at + 1] = mine
        win = (mine > ranks[at]) & (mine > ranks[at + 2])
        got = np.bincount(pair[win], minlength=len(names))
        win &= got[pair] >= least
        new = np.flatnonzero(got >= least)
        name = np.zeros(len(names), dtype=np.int32)
        name[new] = np.arange(len(new)) + FIRST_RULE + n_rules
        hit = at[win]
        symbols[hit] = name[pair[win]]
        stay, next_at = np.ones(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
        stay[hit + 1] = False
        next_at[waiting] = next_at[at] = True
        next_at[hit[hit > 0] - 1] = True
        symbols, next_at = symbols[stay], next_at[stay]
        next_at[-1] = False
        at = np.flatnonzero(next_at).astype(np.int32)
        found.append(np.stack([names[new] >> 32, names[new] & 0xFFFFFFFF], axis=1).astype(np.int32))
        n_rules += len(new)
    rules = np.concatenate([np.zeros((0, 2), dtype=np.int32), *found])
    spans = np.ones(FIRST_RULE + len(rules), dtype=np.int64)
    for a, b in _levels(rules):
        spans[FIRST_RULE + a : FIRST_RULE + b] = spans[rules[a:b]].sum(axis=1)
    return rules, spans[FIRST_RULE:].astype(np.int32), symbols


def _levels(rules: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rules that refer only to rules before their range."""
    out, start, newest = [], 0, rules.max(axis=1, initial=0) - FIRST_RULE
    while start < len(rules):
        late = np.flatnonzero(newest[start:] >= start)
        end = start + int(late[0]) if len(late) else len(rules)
        out.append((start, end))
        start = end
    return out


def _expansions(rules: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, starts): the ids that each symbol below ``FIRST_RULE`` + len(rules) stands for, in a row."""
    sizes = np.concatenate([np.ones(FIRST_RULE, dtype=np.int64), spans])
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), dtype="<u2")
    flat[:FIRST_RULE] = np.arange(FIRST_RULE)
    for a, b in _levels(rules):
        parts = rules[a:b].ravel()
        n = sizes[parts]
        place = np.repeat(starts[parts] - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        flat[starts[FIRST_RULE + a] : starts[FIRST_RULE + a] + len(place)] = flat[place]
    return flat, starts


def expand(rules: np.ndarray, spans: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The ids of a body."""
    flat, starts = _expansions(rules, spans)
    sizes = np.concatenate([np.ones(FIRST_RULE, dtype=np.int64), spans])[body]
    place = np.repeat(starts[body] - (np.cumsum(sizes) - sizes), sizes)
    place += np.arange(len(place))
    return flat[place]


def decode_range(rules: np.ndarray, spans: np.ndarray, body: np.ndarray, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a shard, from the symbols that cover them and the rules that these reach.

    Every pass replaces the nonterminals that are left by their two symbols; other rules aren't looked at.
    """
    sizes = np.ones(len(body), dtype=np.int64)
    big = body >= FIRST_RULE
    sizes[big] = spans[body[big] - FIRST_RULE]
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + n)
    skip = start - (int(ends[a] - sizes[a]) if a < len(ends) else 0)
    part = body[a : b + 1]
    while (big := part >= FIRST_RULE).any():
        first = np.cumsum(1 + big) - (1 + big)
        wider = np.repeat(part, 1 + big)
        pairs = rules[part[big] - FIRST_RULE]
        wider[first[big]], wider[first[big] + 1] = pairs[:, 0], pairs[:, 1]
        part = wider
    return part[skip : skip + n].astype("<u2")


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype=kind).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


COLUMNS = ("part", "piece", "n_docs", "n_ids", "doc_ids", "lengths", "rules", "spans", "body")


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    json_path: str | None = None, ranks_path: str | None = None,
) -> None:
    """Write the ids of ``docs`` as shard files under ``path``, in ascending id order, nulls first.

    Rows with the same id are ordered by a hash of their text. A null text is empty: the end id
    alone. An empty table gives an empty folder. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = [F.col("doc_id"), F.xxhash64("t")]  # rows with the same id may lie in several ranges
    ranged = rows.repartitionByRange(max(1, -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)
    id_kind = rows.schema["doc_id"].dataType

    def shard(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], part: int, piece: int) -> pa.RecordBatch:
        ids = np.concatenate([h[1] for h in held])
        lengths = np.concatenate([h[2] for h in held])
        names = pa.concat_arrays([h[0] for h in held])
        rules, spans, body = compress(ids)
        blobs = [_pack(lengths, "<i8"), _pack(rules, "<i4"), _pack(spans, "<i4"), _pack(body, "<i4")]
        scalars = [pa.array([x], k) for x, k in ((part, pa.int32()), (piece, pa.int32()), (len(lengths), pa.int64()), (len(ids), pa.int64()))]
        listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return pa.RecordBatch.from_arrays([*scalars, listed, *(pa.array([b], pa.binary()) for b in blobs)], list(COLUMNS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(json_path, ranks_path)
        part, piece, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids, lengths = bpe.ids(batch.column(1))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            held.append((batch.column(0), ids, lengths + 1))
            n += len(ids)
            if n >= SHARD_IDS:
                yield shard(held, part, piece)
                piece, held, n = piece + 1, [], 0
        if n:
            yield shard(held, part, piece)
        held.clear()
        release_memory()

    fields = [T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_kind)), *(T.StructField(n, T.BinaryType()) for n in COLUMNS[5:])]
    ranged.mapInArrow(encode, T.StructType(fields)).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str, schema: T.StructType | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under ``path``.

    start counts the ids of all documents before it; ids_crc32 is the unsigned crc32 of its ids as
    little-endian unsigned 32-bit integers, decoded from the grammar.
    """
    import zlib

    small_batches(spark)
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "piece", "n_ids")
    # Starts in two levels: parts one after another, then the pieces of each part.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "piece", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("piece_start")).join(parts, "part")
    starts = starts.select("part", "piece", (F.col("part_start") + F.col("piece_start")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in COLUMNS}
                lengths, spans, body = (unpack(row[n].as_py(), t) for n, t in (("lengths", "<i8"), ("spans", "<i4"), ("body", "<i4")))
                rules = unpack(row["rules"].as_py(), "<i4").reshape(-1, 2)
                ids = memoryview(expand(rules, spans, body).astype("<u4").view(np.uint8))
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                same = [pa.array(np.full(len(lengths), row[n].as_py(), dtype=np.int32)) for n in ("part", "piece")]
                out = [*same, row["doc_ids"].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["part", "piece", "doc_id", "local", "n_tokens", "ids_crc32"])
        release_memory()

    id_kind = shards.schema["doc_ids"].dataType.elementType
    fields = [("part", T.IntegerType()), ("piece", T.IntegerType()), ("doc_id", id_kind), ("local", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    rows = shards.mapInArrow(decode, T.StructType([T.StructField(n, t) for n, t in fields]))
    rows = rows.join(starts, ["part", "piece"])
    return rows.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark, path: str, ids: list) -> DataFrame:
    """(doc_id, ids) of the documents named by ``ids``, a list that is stated by the caller, without null.

    Shards without any of them aren't decoded, and of the others only the ranges of these documents.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType
    asked = sorted(set(ids))
    some = shards.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast(kind) for i in asked]))) if asked else shards.limit(0)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in ("doc_ids", "lengths", "spans", "body", "rules")}
                lengths, spans, body = (unpack(row[n].as_py(), t) for n, t in (("lengths", "<i8"), ("spans", "<i4"), ("body", "<i4")))
                rules, starts = unpack(row["rules"].as_py(), "<i4").reshape(-1, 2), np.cumsum(lengths) - lengths
                names = row["doc_ids"].as_py()
                hits = [d for d, name in enumerate(names) if name in wanted]
                found = [decode_range(rules, spans, body, int(starts[d]), int(lengths[d])).tolist() for d in hits]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values.take(pa.array(hits, pa.int64())), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    wanted = frozenset(asked)
    return some.mapInArrow(decode, T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_file_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to files in the shared folder and report each document as read back from them."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, id_col, text_col)
    return read_token_files(spark, path)
