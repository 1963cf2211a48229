"""Connected components of an edge table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()  # one row
    return tuple(row)


#: Hashed parts of a node's edges: what is found for a node goes to its parts, so no task holds all edges of a hub.
PARTS = 64


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``edges`` with the hashed part of each, (u, part, m): the smallest neighbour ``m`` of u, for each of u's parts)."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "v"), F.lit(PARTS)).cast("int"))
    pieces = dealt.groupBy("u", "part").agg(F.min("v").alias("p"))
    return dealt, pieces.join(pieces.groupBy("u").agg(F.min("p").alias("m")), "u").select("u", "part", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; root: the smallest node reachable.

    Each round links the larger neighbours of every node to its smallest one (large star), then the
    smaller ones (small star). Edges never outnumber those given, and their number of hops shrinks
    geometrically. The driver sees a count and a checksum a round.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "cc-edges")
    before = _state(edges)
    while before[0]:
        both, least = _least(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.filter("v > u").join(least, ["u", "part"]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large, least = _least(large)
        small = large.join(least, ["u", "part"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
