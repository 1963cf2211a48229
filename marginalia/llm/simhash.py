"""Operator 7, SimHash near-dedup: tiled exact comparison of fingerprints.

Fingerprints are compared with those that share a key with them. For the report, 64-bit fingerprints
at ``radius`` or fewer differing bits agree wholly in one of ``radius + 1`` bands of bits, so the
bands' values are the keys and no link is lost. For near copies (:func:`keep_one_each`) fingerprints
have 1024 bits, of the set of five-word shingles: the share of differing bits estimates the angle
between two texts, and the radius leaves room for all texts of similarity 0.8. There the keys are
anchors, pairs of the text's smallest shingles under different orders; texts of similarity 0.8 share
one of six with probability 0.998. Links whose fingerprints alone don't prove the similarity must
also pass a bound by sketches, the smallest ``SKETCH`` hashes of each text's shingles: of texts with
no more shingles than that the similarity itself, of longer ones an estimate with room for four
standard deviations. Those that pass are then held against the texts' shingles, exactly.

What shares a key is cut into tiles. A small one is a single tile; a large one is cut by the number
of one bits (ranges of half the radius) and, above ``TILE`` fingerprints of one count, by hash. Pairs of tiles whose population
counts differ by more than the radius are skipped: they can't hold a link. A pair of tiles meets
under a key of its own and is compared by numpy exclusive-or and bit counts.

A tile pair reports a spanning forest of its links instead of all of them, so a group of n near
copies gives about n rows; the components of the forest are those of the links. Links that need the
exact check enter the forest nearest first, and only where sure ones don't already join their ends.
Where some of them fail it, what they stood for is open again: the tile pairs concerned then report
further links between texts that aren't joined yet, a growing number of the nearest a component in
each round, until all links are checked or lie within a component. Sketches are compared only between
texts that nothing joins yet, and so are texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialise, release_memory, row_keys, small_batches, working_tables
from .components import connected_components

#: Fingerprints in a tile, about.
TILE = 1024
#: Tiles up to this size are compared many at once.
TINY = 48
#: 64-bit words of a wide fingerprint, words of its shingles, and the similarity of near copies.
WIDE, SHINGLE, SIMILAR = 16, 5, 0.8
#: Differing bits of a near copy at most, and up to which no check is needed. At a similarity of 0.8 texts differ in
#: 155 of 1024 bits, give or take 12; the shortest ones, of 4 and 5 shingles, in 192; none in fewer than 126 on average.
NEAR, SURE = 240, 80
#: Links of one text that a task of the exact check should hold, if all links were that text's.
PART_LINKS = 4096
#: Links a component that a tile pair reports in the first round after a failed check, and its growth by round.
FAN, GROWTH = 8, 8
#: Hashes in a sketch, pairs of sketches compared at once, and what stands for no hash.
SKETCH, PAIRS, NONE = 256, 4096, 0xFFFFFFFF
#: Anchors of a text: its smallest shingles under two orders each.
ANCHORS = 6
ODD = (np.arange(1, 2 * ANCHORS + WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's ``width``-word shingles, repeats included; of all its words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)] if words else [], dtype="<u8")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """64-bit words whose bits are set in over half of the rows of ``hashes`` (rows, words)."""
    raw = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8)
    counts = np.zeros(8 * raw.shape[1], dtype=np.int64)
    for at in range(0, len(raw), 255):  # as many as a byte can count
        counts += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(raw), bitorder="little").view("<i8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's ``width``-word shingles; 0 if it has no word."""
    hashes = shingle_hashes(text, width)
    return int(_majority(hashes[:, None])[0]) if len(hashes) else 0


@F.pandas_udf(T.LongType())
def fingerprint_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")
    release_memory()


def wide_fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(words of the 1024-bit SimHash of the set of five-word shingles, anchors); all zero if the text has no word."""
    hashes = np.unique(shingle_hashes(text, SHINGLE))
    if not len(hashes):
        return np.zeros(WIDE, dtype="<i8"), np.zeros(ANCHORS, dtype="<i8")
    bits = np.zeros(8 * 8 * WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] * ODD[None, :WIDE]
        x = ((x ^ (x >> np.uint64(29))) * ODD[1]) ^ (x >> np.uint64(32))
        bits += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    least = np.array([(hashes * k).min() for k in ODD[WIDE:]])
    anchors = (least[::2] ^ (least[1::2] >> np.uint64(7))) * np.uint64(8) + np.arange(ANCHORS, dtype=np.uint64)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8"), anchors.view("<i8")


@F.pandas_udf(T.StructType([T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))]))
def wide_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [wide_fingerprint(t) for t in texts]
        yield pd.DataFrame({"bits": [b for b, _ in rows], "keys": [k for _, k in rows]})
    release_memory()


def sketch_of(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """(number of the text's different shingle hashes of 32 bits, the ``size`` smallest of them)."""
    mixed = (shingle_hashes(text, SHINGLE) * ODD[0]) >> np.uint64(32)
    mixed = np.unique(np.minimum(mixed, np.uint64(NONE - 1)).astype(np.uint32))
    return len(mixed), mixed[:size]


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, sketch) of ``texts`` (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [sketch_of(t, size) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "n": [n for n, _ in rows], "sketch": [k.view("<i4") for _, k in rows]})
        release_memory()

    return texts.mapInPandas(run, "node long, n int, sketch array<int>")


class Sketches:
    """The sketches of several texts, and which pairs of them may have the similarity asked for."""

    def __init__(self, n: np.ndarray, rows: list[np.ndarray], size: int):
        self.n, self.size = n, size
        self.rows = np.full((len(rows), size), NONE, dtype=np.uint32)
        for at, r in zip(self.rows, rows, strict=True):
            at[: len(r)] = np.asarray(r, dtype=np.int32).view(np.uint32)

    def pass_(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False only for pairs (i, j) below the similarity, but for a chance of about 3 in 100,000 for long texts."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = small + 1 >= SIMILAR * (large - 1)  # one less each way: two shingles may share 32 bits
        todo = np.flatnonzero(ok)
        for at in range(0, len(todo), PAIRS):
            part = todo[at : at + PAIRS]
            both = np.sort(np.concatenate([self.rows[i[part]], self.rows[j[part]]], axis=1), axis=1)
            twice = np.zeros(both.shape, dtype=bool)
            twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
            common = twice.sum(axis=1)
            held = np.minimum(self.n[i[part]], self.size) + np.minimum(self.n[j[part]], self.size)
            exact = common + 1 >= SIMILAR * (held - common - 1)
            # The first ``size`` different hashes of both texts' are a sample of their union.
            first = np.cumsum(~twice & (both != NONE), axis=1) <= self.size
            share = (twice & first).sum(axis=1) / self.size
            bound = SIMILAR - 4 * np.sqrt(SIMILAR * (1 - SIMILAR) / self.size)
            ok[part] = np.where(large[part] <= self.size, exact, share >= bound)
        return ok


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that the links (i, j) reach from each of n nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(
    n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, sure: int, sketches: Sketches | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, bits) of a spanning forest of the links (i, j) at d bits among n nodes, and which links are none by the ``sketches``.

    Sure links are given as (node, root, 0); of the others those of least d that join what sure links
    don't. Only links between what isn't joined yet are held against the sketches, the nearest first.
    """
    label = _labels(n, i[d <= sure], j[d <= sure])
    node = np.flatnonzero(label != np.arange(n))
    found = [(node, label[node], np.zeros(len(node), dtype=np.int64))]
    left = np.flatnonzero(d > sure)
    left = left[np.argsort(d[left], kind="stable")]
    good, dead, fan = np.full(len(d), sketches is None), np.zeros(len(d), dtype=bool), FAN
    while True:
        left = left[(label[i[left]] != label[j[left]]) & ~dead[left]]
        if not len(left):
            return *(np.concatenate(part) for part in zip(*found, strict=True)), dead
        new = left[~good[left]]
        if len(new):
            new = new[_nearest_of(label[i[new]], fan) | _nearest_of(label[j[new]], fan)]
            ok = sketches.pass_(i[new], j[new])
            good[new[ok]], dead[new[~ok]] = True, True
            fan *= GROWTH
        sound = left[good[left]]
        a, b, best = label[i[sound]], label[j[sound]], np.full(n, len(sound))
        np.minimum.at(best, a, np.arange(len(sound)))
        np.minimum.at(best, b, np.arange(len(sound)))
        pick = np.unique(best[best < len(sound)])
        found.append((i[sound[pick]], j[sound[pick]], d[sound[pick]]))
        label = _labels(n, a[pick], b[pick])[label]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of ``a`` and ``b`` (rows, words) at d bits, ``radius`` or fewer, and d."""
    step = max(1, (1 << 20) // max(1, b.size))
    found = []
    for at in range(0, len(a), step):
        d = np.bitwise_count(a[at : at + step, None] ^ b[None, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(d <= radius)
        found.append((i + at, j, d[i, j]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _tiny_links(tiles: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): links within each of many small tiles that stand in a row, found together."""
    sizes = np.array([len(t) for t in tiles])
    values, left = np.concatenate(tiles), np.concatenate([np.arange(n, 0, -1) for n in sizes])
    found = []
    for on in range(1, int(sizes.max())):
        i = np.flatnonzero(left > on)  # a later one of the same tile is ``on`` places on
        d = np.bitwise_count(values[i] ^ values[i + on]).sum(axis=1, dtype=np.int32)
        i, d = i[d <= radius], d[d <= radius]
        found.append((i, i + on, d))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _tile(t) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a tile and the words of their fingerprints; a node without any is its own."""
    nodes = np.asarray(t["nodes"], dtype=np.int64)
    bits = t["bits"]
    return nodes, (nodes[:, None] if bits is None else np.concatenate(bits).reshape(len(nodes), -1)).view(np.uint64)


def _sketched(tiles, size: int | None) -> Sketches | None:
    """The sketches of all nodes of ``tiles``, one tile after another; None without ``size``."""
    if size is None:
        return None
    return Sketches(np.concatenate([np.asarray(t["n"], dtype=np.int64) for t in tiles]), [r for t in tiles for r in t["sketch"]], size)


def _links(tiles, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, i, j, d): the links within one tile, or between two."""
    (names, a), *more = map(_tile, tiles)
    if more:
        (others, b), = more
        i, j, d = _near(a, b, radius)
        return np.concatenate([names, others]), i, j + len(a), d
    i, j, d = _near(a, a, radius)
    keep = i < j
    return names, i[keep], j[keep], d[keep]


def _compare(batches: Iterator[pd.DataFrame], radius: int, sure: int, sketch: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows of one tile, or of a tile and another, under a name ``at``, to a forest of their links.

    ``more`` says whether ``at`` has links that need a check and aren't in the forest.
    """

    def rows(at, nodes, i, j, d, sketches):
        node, other, bits, dead = _forest(len(nodes), i, j, d, sure, sketches)
        names, open_ = np.unique(at[i[(d > sure) & ~dead]], return_counts=True)
        given, shown = np.unique(at[node[bits > sure]], return_counts=True)
        open_[np.searchsorted(names, given)] -= shown
        return pd.DataFrame({"at": at[node], "u": nodes[node], "v": nodes[other], "d": bits, "more": np.isin(at[node], names[open_ > 0])})

    for batch in batches:
        tiny = []
        for at, tiles in zip(batch["at"], batch["tiles"], strict=True):
            if len(tiles) == 1 and len(tiles[0]["nodes"]) <= TINY:
                tiny.append((at, *_tile(tiles[0]), tiles[0]))
                continue
            nodes, i, j, d = _links(tiles, radius)
            if len(i):
                yield rows(np.full(len(nodes), at), nodes, i, j, d, _sketched(tiles, sketch))
        if tiny:
            tiny.sort(key=lambda t: len(t[1]))
            i, j, d = _tiny_links([a for _, _, a, _ in tiny], radius)
            if len(i):
                at = np.repeat([t[0] for t in tiny], [len(t[1]) for t in tiny])
                yield rows(at, np.concatenate([t[1] for t in tiny]), i, j, d, _sketched([t[3] for t in tiny], sketch))
    release_memory()


def _nearest_of(label: np.ndarray, fan: int) -> np.ndarray:
    """Whether each entry is among the first ``fan`` of its label."""
    order = np.argsort(label, kind="stable")
    _, start, count = np.unique(label[order], return_index=True, return_counts=True)
    out = np.empty(len(label), dtype=bool)
    out[order] = np.arange(len(label)) - np.repeat(start, count) < fan
    return out


def _compare_again(batches: Iterator[pd.DataFrame], radius: int, fan: int, sketch: int) -> Iterator[pd.DataFrame]:
    """Of the links at ``at`` that join different components and haven't failed, the ``fan`` nearest of each component that pass the sketches' bound."""
    for batch in batches:
        for at, tiles, known, roots, us, vs in batch[["at", "tiles", "known", "roots", "us", "vs"]].itertuples(index=False):
            nodes, i, j, d = _links(tiles, radius)
            order = np.argsort(nodes)

            def places(ids, nodes=nodes, order=order):
                return order[np.searchsorted(nodes, np.asarray(ids, dtype=np.int64), sorter=order)]

            label = nodes.copy()
            label[places(known)] = np.asarray(roots, dtype=np.int64)
            pair = np.minimum(i, j) * len(nodes) + np.maximum(i, j)
            a, b = places(us), places(vs)
            left = np.flatnonzero((label[i] != label[j]) & ~np.isin(pair, np.minimum(a, b) * len(nodes) + np.maximum(a, b)))
            left = left[_sketched(tiles, sketch).pass_(i[left], j[left])]
            left = left[np.argsort(d[left], kind="stable")]
            pick = left[_nearest_of(label[i[left]], fan) | _nearest_of(label[j[left]], fan)]
            if len(pick):
                yield pd.DataFrame({"at": at, "u": nodes[i[pick]], "v": nodes[j[pick]], "d": d[pick], "more": len(pick) < len(left)})
    release_memory()


def _band_keys(fp: Column, bands: int) -> Column:
    edges = [64 * b // bands for b in range(bands + 1)]
    return F.array(*[
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * bands + b
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def _tiles(entries: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Tiles (key, tile, chunk, t) of ``entries`` (node, pop, bits, key; n and sketch, if they have any), and names ``at`` of the pairs of them to compare."""
    more = [c for c in ("n", "sketch") if c in entries.columns]
    wide = max(1, radius // 2)  # population counts in a tile: one, where the radius tells them apart
    entries = entries.withColumn("bin", F.floor(F.col("pop") / wide))
    counts = entries.groupBy("key", "bin").agg(F.count("*").alias("c"))
    counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy("key"))).filter("n > 1")  # a row a population count
    cut = F.col("n") > TILE
    counts = counts.select(
        "key", "bin", F.when(cut, F.col("bin")).otherwise(-1).alias("tile"),
        F.when(cut, F.ceil(F.col("c") / TILE)).otherwise(1).alias("chunks"))
    counts = materialise(counts, "simhash-counts")
    tiles = entries.join(counts, ["key", "bin"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    tiles = tiles.groupBy("key", "tile", "chunk").agg(F.collect_list("node").alias("nodes"), F.collect_list("bits").alias("bits"), *[F.collect_list(c).alias(c) for c in more])
    bits = F.when(F.size("bits") > 0, F.col("bits"))
    tiles = materialise(tiles.select("key", "tile", "chunk", F.struct("nodes", bits.alias("bits"), *more).alias("t")), "simhash-tiles")

    # A large key's tiles within the radius meet two by two: each pair under a name of its own.
    large = counts.filter("tile >= 0").select("key", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    other = large.select("key", F.col("tile").alias("tile2"), F.col("chunk").alias("chunk2"))
    pairs = large.join(other, "key").filter(
        (F.col("tile2") >= F.col("tile")) & ((F.col("tile2") - F.col("tile") - 1) * wide + 1 <= radius)
        & ((F.col("tile2") > F.col("tile")) | (F.col("chunk2") > F.col("chunk"))))
    return tiles, pairs.withColumn("at", F.xxhash64("key", "tile", "chunk", "tile2", "chunk2"))


def _meetings(tiles: DataFrame, pairs: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(at, tiles) of each tile alone and each of ``pairs``; only those that ``some`` (at) names, if given."""
    alone = tiles.filter(F.size("t.nodes") > 1).select(F.xxhash64("key", "tile", "chunk").alias("at"), F.array("t").alias("tiles"))
    if some is not None:
        alone, pairs = alone.join(some, "at", "left_semi"), pairs.join(some, "at", "left_semi")
    sides = pairs.select("at", "key", "tile", "chunk").union(pairs.select("at", "key", "tile2", "chunk2"))
    met = tiles.filter("tile >= 0").join(sides, ["key", "tile", "chunk"]).groupBy("at").agg(F.collect_list("t").alias("tiles"))
    return alone.union(met)


LINKS = "at long, u long, v long, d int, more boolean"


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """A spanning forest (u, v) of all pairs in ``distinct`` (fp) at ``radius`` or fewer differing bits."""
    keys = F.explode(_band_keys(F.col("fp"), radius + 1)).alias("key")
    bits = F.lit(None).cast("array<bigint>").alias("bits")
    tiles, pairs = _tiles(distinct.select(F.col("fp").alias("node"), F.bit_count("fp").alias("pop"), bits, keys), radius)
    return _meetings(tiles, pairs).mapInPandas(lambda batches: _compare(batches, radius, radius), LINKS).select("u", "v")


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the pairs (u, v) with their two texts, those whose sets of shingles are similar."""
    for batch in batches:
        keep = []
        for one, other in batch["texts"]:
            a, b = (np.unique(shingle_hashes(t, SHINGLE)) for t in (one, other))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= SIMILAR * (len(a) + len(b) - both))
        yield batch.loc[np.array(keep, dtype=bool), ["u", "v"]]
    release_memory()


def _checked(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The (u, v) of ``links`` whose texts are similar; ``texts`` has (node, text).

    A text is sent to the hashed parts of its links first, so no task holds all links of one text.
    """
    parts = max(64, -(-links.count() // PART_LINKS))
    part = F.pmod(F.xxhash64("u", "v"), F.lit(parts)).cast("int").alias("part")
    sides = links.select("u", "v", part, F.explode(F.array("u", "v")).alias("node"))
    sent = sides.select("node", "part").distinct().join(texts, "node")
    met = sides.join(sent, ["node", "part"]).groupBy("u", "v").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    return met.mapInPandas(_similar, "u long, v long")


def _near_copies(first: DataFrame, docs: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """(node, root) of the groups of near copies among ``first`` (node, did, tk, bits, keys); ``docs`` has (did, tk, text).

    Texts that share an anchor with others are stored once, for their sketches (of ``sketch`` hashes)
    and the exact checks.

    The driver sees two counts a round. Rounds end when no link is left that is neither checked nor
    within a component; their fan grows, so a tile pair of n texts has about log(n) of them.
    """
    pop = F.aggregate("bits", F.lit(0), lambda s, x: s + F.bit_count(x))
    entries = first.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    # Stored, so that the joins with all texts know this side's size.
    ends = entries.join(shared, "key", "left_semi").select("node").distinct()
    ends = materialise(first.select("node", "did", "tk").join(ends, "node", "left_semi"), "simhash-ends")
    texts = materialise(docs.join(ends, ["did", "tk"]).groupBy("node").agg(F.first("text").alias("text")), "simhash-texts")
    sketched = materialise(_sketches(texts, sketch), "simhash-sketches")
    entries = first.select("node", pop.alias("pop"), "bits", "keys").join(sketched, "node")
    tiles, pairs = _tiles(entries.select("node", "pop", "bits", "n", "sketch", F.explode(F.array_distinct("keys")).alias("key")), NEAR)
    links = _meetings(tiles, pairs).mapInPandas(lambda batches: _compare(batches, NEAR, SURE, sketch), LINKS)
    links = materialise(links, "simhash-links")
    joined = links.filter("d = 0").select("u", "v").distinct()
    links = links.filter("d > 0").select("at", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "more")
    roots, fan = materialise(connected_components(joined), "simhash-roots"), FAN
    failed = before = None
    while True:
        open_ = links.select("u", "v").distinct()
        if failed is not None:
            open_ = open_.join(failed, ["u", "v"], "left_anti")
        for end in ("u", "v"):
            root = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            open_ = open_.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        open_ = materialise(open_.filter("root_u <> root_v").select("u", "v"), "simhash-open")
        passed = materialise(_checked(open_, texts), "simhash-passed")
        joined = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(passed)
        roots = materialise(connected_components(joined), "simhash-roots")
        new = open_.join(passed, ["u", "v"], "left_anti")
        failed = materialise(new if failed is None else failed.union(new), "simhash-failed")
        missed = links.join(failed, ["u", "v"], "left_semi")
        # A forest whose links all hold leaves none open; of the rounds' links any tile pair may have further ones.
        again = (missed if before is None else links).filter("more").select("at").distinct()
        again = materialise(again, "simhash-again")
        if not again.count():
            return roots
        missed = missed.select("at", "u", "v")
        before = materialise((missed if before is None else missed.union(before)).join(again, "at", "left_semi"), "simhash-missed")
        links, fan = materialise(_further(_meetings(tiles, pairs, again), before, roots, fan, sketch), "simhash-links"), fan * GROWTH


def _further(meetings: DataFrame, missed: DataFrame, roots: DataFrame, fan: int, sketch: int) -> DataFrame:
    """(at, u, v, more): links of ``meetings`` between components; ``missed`` (at, u, v) has those that failed."""
    nodes = meetings.select("at", F.explode(F.flatten("tiles.nodes")).alias("node"))
    known = nodes.join(roots, "node").groupBy("at").agg(F.collect_list("node").alias("known"), F.collect_list("root").alias("roots"))
    bad = missed.groupBy("at").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))
    none = F.array().cast("array<bigint>")
    sent = meetings.join(known, "at", "left").join(bad, "at", "left")
    sent = sent.select("at", "tiles", *[F.coalesce(c, none).alias(c) for c in ("known", "roots", "us", "vs")])
    found = sent.mapInPandas(lambda batches: _compare_again(batches, NEAR, fan, sketch), LINKS)
    return found.select("at", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "more")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable by links) of every row.

    Null and blank texts have fingerprint zero and link like any other. Null ids take part and never
    are a component_id, unless a component has no other. Repeated rows each come back. An empty table
    gives no rows. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col).cast("string")).alias("fp"))
    prints = materialise(prints, "simhash-prints")
    first = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(near_links(first.select("fp"), radius))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    parts = prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp")
    return parts.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group, the row with its smallest id stays, once; all columns kept.

    Groups are the components of links between texts whose sets of five-word shingles have a
    similarity of 0.8 or more; a link whose fingerprints differ in over :data:`SURE` bits of 1024 is
    checked exactly. Two such texts may be missed where they share no anchor (one in 500 at 0.8).
    Letter case of A-Z and blanks don't count. Texts without a word (null, empty, blank) are one group. Shorter texts than five words are
    one shingle. Rows with a null id come after all others, the smallest text hash first. Repeated
    rows count as copies. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keys = row_keys(id_col, text_col)
    with working_tables(docs.sparkSession) as keep:
        prints = docs.select(*keys, wide_udf(F.col(text_col).cast("string")).alias("p"))
        prints = materialise(prints.select("did", "tk", "p.bits", "p.keys", F.xxhash64("p.bits").alias("node")), "simhash-wide")
        first = prints.groupBy("node").agg(F.min(F.struct("did", "tk", "keys", "bits")).alias("first"))
        first = keep(materialise(first.select("node", "first.*"), "simhash-distinct"))
        roots = keep(_near_copies(first, docs.select(*keys, F.col(text_col).cast("string").alias("text"))))
    rooted = first.select("node", "did", "tk").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("did", "tk").alias("row"))
    best = rooted.groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    did, tk = free_names(docs, "did", "tk")
    keyed = docs.select("*", keys[0].alias(did), keys[1].alias(tk))
    kept = keyed.join(best.select(F.col("did").alias(did), F.col("tk").alias(tk)), [did, tk], "left_semi").dropDuplicates([did, tk])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
