"""Operator 10, SentencePiece encoding and decoding: Gumbel top-k without replacement.

A text's lattice is the chain of the lattices of its units: a unit is a run of spaces with the other
characters up to the next space, and no piece crosses from one to the next. Its paths have
probabilities in proportion to the product of their pieces' weights. Perturbing each path's log
probability by Gumbel noise and taking the ``k`` largest gives ``k`` distinct paths, a sample without
replacement.

The search finds them without listing paths. The whole lattice's largest perturbed value is drawn
first, then the path that has it. What remains is split by the step at which a path first leaves an
emitted one; each such region's mass is known exactly from the backward sums, so its largest value
can be drawn, cut at its parent's. The queue of regions is served largest first (the bound of a
region is its own largest value, so the order is exact), each time giving the next path.

All noise is a function of the row's key. The inclusion score of a path is the chance that it is
among the emitted ones given the next largest perturbed value: 1 - exp(-exp(log p - next)).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, small_batches
from .piece_lattice import MARK, Lattice, Pieces, build, uniform, walk

#: Bytes of text taken at once; a longer text is taken alone. A slice needs about 200 bytes of memory a byte.
SLICE_BYTES = 512 << 10


@lru_cache(maxsize=2)
def worker_pieces(model_path: str | None = None, power: float = 1.0) -> Pieces:
    import public_tokenizers

    return Pieces(model_path or public_tokenizers.path("piece_bpe_32k.model"), power)


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, sizes) of the distinct units, and (unit of each place, places of each text).

    A space stands before every text that isn't empty; the mark of spaces in a text is a space.
    """
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    full = np.diff(ends) > 0
    begin = ends[:-1] - ends[0]
    raw = np.insert(raw, begin[full], ord(" "))
    begin = begin + np.cumsum(full) - full
    space = raw == ord(" ")
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[begin[full]] = True
    cuts = np.append(np.flatnonzero(head), len(raw))
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw))
    coded = units.dictionary_encode()
    names = coded.dictionary
    points = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    points[points == ord(" ")] = ord(MARK)
    places = np.diff(np.searchsorted(cuts[:-1], np.append(begin, len(raw))))
    return points, pc.utf8_length(names).to_numpy(), coded.indices.to_numpy().astype(np.int64), places


class Paths:
    """One emitted path for each of some texts: its edges, and the regions around it."""

    def __init__(self, rows, edges, lengths, logs, value, lattice: Lattice, keys, stream: int, since, floor_mass):
        """``since``: the step from which regions are its own; ``floor_mass``: log mass of the region at that step, if given."""
        self.rows, self.edges, self.lengths, self.value = rows, edges, lengths, value
        self.begin = np.cumsum(lengths) - lengths
        self.total = np.zeros(len(rows))
        owner = np.repeat(np.arange(len(rows)), lengths)
        run = np.append(0.0, np.cumsum(logs))
        before = run[:-1] - run[self.begin[owner]] if len(owner) else np.zeros(0)
        self.total = run[self.begin + lengths] - run[self.begin]
        chance = lattice.chance[edges]
        step = np.arange(len(edges)) - self.begin[owner] if len(owner) else np.zeros(0, dtype=np.int64)
        with np.errstate(divide="ignore"):
            mass = before + np.log1p(-chance)
            mass[chance > 1 - 1e-12] = -np.inf  # the node has no other way
            if since is not None:
                mass[step < since[owner]] = -np.inf
                at = self.begin + since
                mass[at] = before[at] + np.where(floor_mass > 1e-12, np.log(np.maximum(floor_mass, 1e-300)), -np.inf)
            noise = -np.log(uniform(keys[rows][owner], stream, step + (1 << 40)))
            self.best = np.full(len(edges), -np.inf)
            some = np.flatnonzero(mass > -np.inf)
            below = -np.logaddexp(-value[owner[some]], np.log(noise[some]) - mass[some])
            self.best[some] = np.minimum(below, value[owner[some]])

    def top(self, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the largest value of a region here, and its step; -inf if none."""
        value, step = np.full(n_rows, -np.inf), np.zeros(n_rows, dtype=np.int64)
        full = np.flatnonzero(self.lengths > 0)
        if len(full):
            most = np.maximum.reduceat(self.best, self.begin[full])
            hit = np.flatnonzero(self.best == np.repeat(most, self.lengths[full]))
            owner = np.repeat(full, self.lengths[full])[hit]
            owner, first = np.unique(owner, return_index=True)
            value[self.rows[full]] = most
            step[self.rows[owner]] = hit[first] - self.begin[owner]
        return value, step


def sample_paths(lattice: Lattice, codes: np.ndarray, places: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """The ``k`` paths of each text (fewer if it has fewer), best perturbed value first, and the next value after them."""
    n = len(places)
    owner = np.repeat(np.arange(n), places)
    ordinal = np.arange(len(codes)) - (np.cumsum(places) - places)[owner]
    edges, counts = walk(lattice, lattice.start[codes], keys[owner], np.zeros(len(codes), dtype=np.uint64), ordinal)
    lengths = np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
    value = -np.log(-np.log(uniform(keys, 1, np.zeros(n, dtype=np.int64))))
    with np.errstate(divide="ignore"):
        # In steps of 2^-30 sums are exact, so that a text's scores don't depend on what stands before it.
        log_chance = np.round(np.log(lattice.chance) * 2.0**30) / 2.0**30
    emitted = [Paths(np.arange(n), edges, lengths, log_chance[edges], value, lattice, keys, 2, None, None)]
    gone: list[dict[tuple[int, int], list[int]]] = [{}]  # edges that a region at a step leaves out, beside the path's own
    word_of = [np.repeat(np.arange(len(codes)), counts)]
    for r in range(1, k + 1):
        tops = [p.top(n) for p in emitted]
        best = np.stack([t[0] for t in tops])
        parent = best.argmax(axis=0)
        value = best[parent, np.arange(n)]
        if r == k:
            return emitted, value
        rows = np.flatnonzero(value > -np.inf)
        step = np.array([tops[parent[i]][1][i] for i in rows], dtype=np.int64)
        first_edge, floor, resume, left_out = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64), {}
        draw = uniform(keys[rows], 100 + r, np.zeros(len(rows), dtype=np.int64))
        index_in = [np.full(n, -1) for _ in emitted]
        for p, path in enumerate(emitted):
            index_in[p][path.rows] = np.arange(len(path.rows))
        prefix, prefix_words = [], []
        for j, i in enumerate(rows.tolist()):
            path, me = emitted[parent[i]], index_in[parent[i]][i]
            at = path.begin[me] + step[j]
            edge = path.edges[at]
            out = gone[parent[i]].get((i, int(step[j])), []) + [int(edge)]
            node = np.searchsorted(lattice.first, edge, side="right") - 1
            options = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in out]
            chances = np.cumsum(lattice.chance[options])
            pick = min(int(np.searchsorted(chances, draw[j] * chances[-1])), len(options) - 1)
            first_edge[j] = options[pick]
            floor[j] = max(0.0, chances[-1] - lattice.chance[options[pick]]) if len(options) > 1 else 0.0
            left_out[i, int(step[j])] = out
            path.best[at] = -np.inf
            prefix.append(path.edges[path.begin[me] : at])
            prefix_words.append(word_of[parent[i]][path.begin[me] : at + 1])
            resume[j] = word_of[parent[i]][at]
        # The rest of the unit in which the path leaves its parent, and all later units of the text, are drawn anew.
        last = np.cumsum(places)[rows]
        later = last - resume
        who = np.repeat(np.arange(len(rows)), later)
        word = np.repeat(resume - (np.cumsum(later) - later), later) + np.arange(int(later.sum()))
        nodes = lattice.start[codes[word]]
        nodes[np.cumsum(later) - later] = lattice.target[first_edge]
        tail, tail_counts = walk(lattice, nodes, keys[rows][who], np.full(len(who), 200 + r, dtype=np.uint64), ordinal[word])
        tail_n = np.bincount(who, weights=tail_counts, minlength=len(rows)).astype(np.int64)
        tail_words = np.repeat(word, tail_counts)
        cuts = np.cumsum(tail_n)
        edges, words = [], []
        for j, (a, b) in enumerate(zip((cuts - tail_n).tolist(), cuts.tolist())):
            edges += [prefix[j], first_edge[j : j + 1], tail[a:b]]
            words += [prefix_words[j], tail_words[a:b]]
        edges = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        word_of.append(np.concatenate(words) if words else np.zeros(0, dtype=np.int64))
        gone.append(left_out)
        emitted.append(Paths(rows, edges, step + 1 + tail_n, log_chance[edges], value[rows], lattice, keys, 2 + r, step, floor))
    return emitted, value


def _expand(pieces: Pieces, which: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of edges' pieces; a character that no piece covers gives the ids of its bytes."""
    odd = np.flatnonzero(which >= pieces.size)
    if not len(odd):
        return which, lengths
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in (which[odd] - pieces.size).tolist()]
    n = np.ones(len(which), dtype=np.int64)
    n[odd] = [len(b) for b in raw]
    out = np.repeat(which, n)
    out[np.repeat(which >= pieces.size, n)] = pieces.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return out, np.bincount(owner, weights=n, minlength=len(lengths)).astype(np.int64)


def decode(pieces: Pieces, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each row of ids; the space that stands before the first word goes."""
    if not hasattr(pieces, "pool"):
        sizes = np.fromiter(map(len, pieces.bytes), dtype=np.int64, count=pieces.size)
        pieces.pool = (np.frombuffer(b"".join(pieces.bytes), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
    pool, starts, sizes = pieces.pool
    n = sizes[ids]
    ends = np.cumsum(n)
    raw = pool[np.repeat(starts[ids] - (ends - n), n) + np.arange(int(n.sum()))].tobytes()
    cuts = np.append(0, ends)[np.append(0, np.cumsum(lengths))].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _samples(texts: pa.Array, keys: np.ndarray, k: int, pieces: Pieces) -> Iterator[tuple[int, *tuple[np.ndarray, ...]]]:
    """For each sample number: (number, texts that have it, ids, their counts, log_prob, perturbed, inclusion, log_inclusion)."""
    points, sizes, codes, places = _units(texts)
    lattice = build(pieces, points, sizes)
    emitted, after = sample_paths(lattice, codes, places, keys, k)
    for r, path in enumerate(emitted):
        ids, lengths = _expand(pieces, lattice.piece[path.edges], path.lengths)
        above = path.total - after[path.rows]
        inclusion = -np.expm1(-np.exp(np.minimum(above, 700)))
        # Of a long text's paths each is so unlikely that the score itself falls below the smallest double.
        log_inclusion = np.where(above < -30, above, np.log(np.maximum(inclusion, 1e-300)))
        yield r + 1, path.rows, ids, lengths, path.total, path.value, inclusion, log_inclusion


def sampled_encodings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, model_path: str | None = None, power: float = 1.0, seed: int = 0
) -> DataFrame:
    """doc_id, sample, ids, n_pieces, log_prob, perturbed, inclusion, log_inclusion, decoded_crc32 and n_bytes of every whole text.

    sample counts from 1 in falling order of the perturbed log probability; ids is an array of int.
    log_inclusion is the logarithm of inclusion, which for long texts is too small for a double.
    The last two tell the text that the ids stand for (see :func:`decode_ids`): its unsigned crc32
    and its UTF-8 length. That is the given text, but for the mark of spaces (U+2581), which decodes
    to a space, as with the library. A text with fewer than ``k`` segmentations gives fewer rows, each with
    inclusion 1; a null or empty text gives one row without ids. The noise depends on ``seed``, id and
    text only, so repeated rows give the same samples and results don't depend on partitions. Null
    ids are kept. An empty table gives no rows. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("key"), text.alias("t"))
    fields = [("sample", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("inclusion", T.DoubleType()), ("log_inclusion", T.DoubleType()), ("decoded_crc32", T.LongType()), ("n_bytes", T.LongType())]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(model_path, power)
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=0)).tolist()
            for a, e in zip([0, *cuts], [*cuts, b.num_rows]):
                if a == e:
                    continue
                part = b.slice(a, e - a)
                keys = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                for number, at, ids, lengths, *scores in _samples(part.column(2).cast(pa.large_string()), keys, k, pieces):
                    texts = decode(pieces, ids, lengths)
                    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(ids, pa.int32()))
                    told = [pa.array([f(t) for t in texts], pa.int64()) for f in (zlib.crc32, len)]
                    out = [part.column(0).take(pa.array(at)), pa.array(np.full(len(at), number, dtype=np.int32)), listed, pa.array(lengths), *map(pa.array, scores), *told]
                    yield pa.RecordBatch.from_arrays(out, schema.names)
        release_memory()

    return rows.mapInArrow(run, schema)


def decode_ids(encodings: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``encodings`` with the text of each row's ids in ``out_col``; null ids give null. All columns are kept."""
    small_batches(encodings.sparkSession)
    kept = encodings.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(model_path)
        for b in batches:
            listed = b.column(at)
            lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode(pieces, listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            texts = [t if ok else None for t, ok in zip(texts, listed.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return kept.mapInArrow(run, schema)
