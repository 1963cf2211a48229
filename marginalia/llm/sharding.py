"""Operator 1, sharding: balanced label propagation, in DataFrame operations only.

Documents that share a link (here: an equal text) should lie in one shard, and shards must stay
even. Links are kept as a star (document - link), so a link of any size costs one row for each
document and no pairs. Every round

1. counts, for each link, its documents in each shard (the votes of the neighbours),
2. lets a document ask for the shard with room that holds more of its neighbours than its own,
3. admits requests up to the room that a shard's quota of linked documents leaves.

Documents without links are filler: after the last round those above a shard's quota move to the
shards below theirs. Quotas differ by one at most, so law ``rows`` holds exactly.

Orders inside a shard (who is admitted, slots) are found in two levels: counts for hashed buckets
of bounded size, a running sum over the bucket counts, and a row number inside each bucket. No
shard, and no link, is ever sorted in one task. Documents also lie in hashed parts: what is found
for a link goes to its parts first, so no join brings all documents of a link together.

Rounds go on until none moves a document. They end: a document moves only to a shard that holds at
least as many of its neighbours, which raises the sum of the squared votes each time.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows that one bucket of a shard should hold, and a part of the hottest possible link at most, about.
BUCKET_ROWS = 1024
PART_ROWS = 4096


def _literal_array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(_literal_array(values), index + 1)


def _ranked(df: DataFrame, group: list[str], buckets: int, first: list[Column]) -> DataFrame:
    """``rank`` from 1 in each ``group``, in the order (``first``'s bucketless key, bucket, nid)."""
    # A hash of its own: shards come from the plain one, and a shard's rows would share a few buckets.
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "nid"), F.lit(buckets)))
    keyed = keyed.withColumns({f"o{i}": c for i, c in enumerate(first)})
    order = [*[f"o{i}" for i in range(len(first))], "bucket"]
    counts = keyed.groupBy(*group, *order).agg(F.count("*").alias("cnt"))
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, *order, F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*group, *order).orderBy("nid")
    out = keyed.join(starts, [*group, *order]).withColumn("rank", F.col("start") + F.row_number().over(inside))
    return out.drop("bucket", "start", *[f"o{i}" for i in range(len(first))])


def _round(linked: DataFrame, quotas: list[int], shards: int) -> DataFrame | None:
    """One round of propagation over ``linked`` (nid, link, part, shard, went); None if the last round moved nothing."""
    load = linked.groupBy("shard").agg(F.count("*").alias("n"), F.max("went").alias("went")).collect()  # one row a shard
    if not any(r["went"] for r in load):
        return None
    load = {r["shard"]: r["n"] for r in load}
    room = [max(0, q - load.get(s, 0)) for s, q in enumerate(quotas)]
    # One long orders (votes, shards with room first, smaller shard first), so that the maximum needs no
    # sort. Of two shards with equal votes the full one gives way, or its documents and those that
    # wait for its room would stay apart.
    open_ = _at(room, F.col("shard")) > 0
    score = (F.col("votes") * 2 + open_.cast("int")) * shards + (shards - 1 - F.col("shard"))
    pieces = linked.groupBy("link", "part", "shard").agg(F.count("*").alias("c"))
    votes = pieces.groupBy("link", "shard").agg(F.sum("c").alias("votes")).select(
        "link", "shard", score.alias("own"),
        F.max(F.when(open_, score)).over(Window.partitionBy("link")).alias("best"))
    asks = votes.filter("best > own").select("link", "shard", (shards - 1 - F.pmod("best", F.lit(shards))).cast("int").alias("target"))
    asks = pieces.join(asks, ["link", "shard"]).select("link", "part", "shard", "target")
    movers = linked.join(asks, ["link", "part", "shard"]).select("nid", "target")
    n = sum(load.values())
    ranked = _ranked(movers, ["target"], max(16, -(-n // (shards * BUCKET_ROWS))), [])
    moved = ranked.filter(F.col("rank") <= _at(room, F.col("target"))).select("nid", "target")
    return materialise(
        linked.join(moved, "nid", "left").select(
            "nid", "link", "part", F.coalesce("target", "shard").alias("shard"), F.col("target").isNotNull().alias("went")), "shard-round")


def balanced_label_propagation(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rounds: int | None = None
) -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``rounds`` ends the propagation early; by default it ends when no document moves.
    size is the UTF-8 length plus 8. A null text has length 0 and crc 0 and links to nothing; the
    empty text is a text like any other. Repeated rows are rows of their own, linked by their text;
    a null id is kept as it is. Ties between shards go to the smaller number. An empty table gives
    no rows. Further columns of ``docs`` are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    nodes = docs.select(
        F.monotonically_increasing_id().alias("nid"), F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(F.xxhash64(text), size, crc)).alias("link"))
    # Written before it is used: row numbers of a scan hold only once they are stored.
    nodes = materialise(nodes.withColumn("shard", F.pmod(F.xxhash64("nid"), F.lit(shards)).cast("int")), "shard-nodes")
    total = nodes.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    part = F.pmod(F.xxhash64(F.lit("part"), "nid"), F.lit(max(64, -(-total // PART_ROWS)))).cast("int")
    linked = nodes.filter("link is not null").select("nid", "link", part.alias("part"), "shard")
    pieces = linked.groupBy("link", "part").agg(F.count("*").alias("c"))
    ties = pieces.groupBy("link").agg(F.sum("c").alias("n")).filter("n > 1")
    linked = linked.join(pieces.join(ties, "link", "left_semi"), ["link", "part"], "left_semi")
    linked = materialise(linked.select("nid", "link", "part", "shard", F.lit(True).alias("went")), "shard-linked")
    for _ in itertools.count() if rounds is None else range(rounds):
        after = _round(linked, quotas, shards)
        if after is None:
            break
        linked = after

    placed = nodes.drop("shard", "link").join(linked.select("nid", F.col("shard").alias("led")), "nid", "left")
    placed = placed.select(
        "nid", "doc_id", "size", "text_crc32", F.col("led").isNull().cast("int").alias("free"),
        F.coalesce("led", F.pmod(F.xxhash64("nid"), F.lit(shards)).cast("int")).alias("home"))
    placed = materialise(placed, "shard-placed")
    have = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # one row a shard
    have = [have.get(s, 0) for s in range(shards)]
    over, under = [0], [0]  # running sums of what is above and below the quotas
    for h, q in zip(have, quotas, strict=True):
        over.append(over[-1] + max(0, h - q))
        under.append(under[-1] + max(0, q - h))
    ranked = _ranked(placed, ["home"], max(16, -(-total // (shards * BUCKET_ROWS))), [F.col("free")])
    spare = _at(over[:-1], F.col("home")) + F.col("rank") - _at(quotas, F.col("home")) - 1  # number among those that must go
    ranked = ranked.withColumn("spare", F.when(F.col("rank") > _at(quotas, F.col("home")), spare))
    goes_to = F.lit(0)
    for u in under[1:-1]:
        goes_to = goes_to + (F.col("spare") >= u).cast("int")
    ranked = ranked.withColumn("shard", F.when(F.col("spare").isNull(), F.col("home")).otherwise(goes_to).cast("int"))
    slot = F.when(F.col("spare").isNull(), F.col("rank") - 1).otherwise(
        _at(have, F.col("shard")) + F.col("spare") - _at(under[:-1], F.col("shard")))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
