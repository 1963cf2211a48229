"""Sources: provenance links, centroids, and the graph of similar sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_of, trimmed
from ..functions.vectors import l2_distance
from ..schema import SIMILAR_LIMIT, SOURCE_LINK_LIMIT, SOURCE_LIST_LIMIT, clamp


def centroid_terms(source_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source_id, pos, mean, n): element-wise means over the atoms that exist, not normalised.

    Sums are formed by (source, position) on the map side, so one source may own any share of atoms.
    """
    vectors = atoms.select(F.col("id").alias("atom_id"), F.posexplode("vector").alias("pos", "x"))
    joined = source_atoms.select("source_id", "atom_id").join(vectors, "atom_id")
    return joined.groupBy("source_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def source_indexes(source_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source_id, embedding, atom_count): a centroid for each source with an atom that exists."""
    terms = centroid_terms(source_atoms, atoms).groupBy("source_id")
    out = terms.agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("t"), F.max("n").cast("int").alias("atom_count"))
    return out.select("source_id", F.col("t.mean").alias("embedding"), "atom_count")


#: Entries are summed as whole multiples of 2**-32, so that sums don't depend on order and unlinking undoes linking.
UNIT = 1 << 32


def centroid_sums(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source_id, pos, total, n) over the ``pairs`` (source_id, atom_id) whose atom exists, summed on the map side."""
    vectors = atoms.select(F.col("id").alias("atom_id"), F.posexplode("vector").alias("pos", "x"))
    joined = pairs.select("source_id", "atom_id").join(vectors, "atom_id")
    return joined.groupBy("source_id", "pos").agg(F.sum(F.round(F.col("x").cast("double") * UNIT).cast("long")).alias("total"), F.count("*").alias("n"))


def centroid_sums_after(sums: DataFrame, atoms: DataFrame, linked: DataFrame | None = None, unlinked: DataFrame | None = None) -> DataFrame:
    """``sums`` after pairs were linked and unlinked: only these pairs' atoms are read.

    Pairs that were linked before, or that weren't, must not be among them (see :func:`link_atoms` and
    :func:`returned`); an atom that is deleted has to be unlinked while it still exists.
    """
    rows = sums.select("source_id", "pos", "total", "n")
    if linked is not None:
        rows = rows.union(centroid_sums(linked, atoms))
    if unlinked is not None:
        rows = rows.union(centroid_sums(unlinked, atoms).select("source_id", "pos", -F.col("total"), -F.col("n")))
    return rows.groupBy("source_id", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")


def centroids(sums: DataFrame) -> DataFrame:
    """(source_id, embedding, atom_count) from the stored sums."""
    mean = F.col("total") / UNIT / F.col("n")
    out = sums.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", mean.alias("mean")))).alias("t"), F.max("n").cast("int").alias("atom_count"))
    return out.select("source_id", F.col("t.mean").alias("embedding"), "atom_count")


def refreshed_indexes(indexes: DataFrame, changed: DataFrame, source_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """``indexes`` with the centroids of the ``changed`` sources (source_id) found anew; those without an atom go."""
    touched = source_atoms.join(changed.select("source_id"), "source_id", "left_semi")
    kept = indexes.select("source_id", "embedding", "atom_count").join(changed.select("source_id"), "source_id", "left_anti")
    return kept.unionByName(source_indexes(touched, atoms))


def atom_counts(source_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source_id, link_count, atom_count): all links, and those whose atom exists."""
    there = atoms.select(F.col("id").alias("atom_id"), F.lit(1).alias("there"))
    joined = source_atoms.select("source_id", "atom_id").join(there, "atom_id", "left")
    return joined.groupBy("source_id").agg(F.count("*").alias("link_count"), F.count("there").alias("atom_count"))


def find_similar(indexes: DataFrame, source_id: int, limit: int | None = None) -> DataFrame:
    """(source_id, distance) of the sources whose centroids are nearest to one source's; none without an index."""
    base = indexes.filter(F.col("source_id") == source_id).select(F.col("source_id").alias("base_id"), F.col("embedding").alias("base"))
    # One pinned row is joined with every other source.
    near = indexes.join(F.broadcast(base.limit(1)), F.col("source_id") != F.col("base_id"))
    near = near.select("source_id", l2_distance(F.col("embedding"), F.col("base")).alias("distance"))
    return near.orderBy("distance", "source_id").limit(clamp(limit, SIMILAR_LIMIT))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, ``new`` winning; columns of ``old``. One row a key."""
    rows = new.select(*old.columns, F.lit(0).alias("__age")).unionByName(old.withColumn("__age", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy("__age")
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*old.columns)


def link_similar(links: DataFrame, indexes: DataFrame, source_id: int, limit: int | None = None) -> DataFrame:
    """All links after those of ``source_id`` to its nearest sources are set; earlier ones stay."""
    near = find_similar(indexes, source_id, limit)
    new = near.select(F.lit(source_id).cast("long").alias("source_id"), F.col("source_id").alias("target_source_id"), "distance", F.lit("centroid").alias("method"))
    return upsert(links.select("source_id", "target_source_id", "distance", "method"), new, ["source_id", "target_source_id"])


def links_of(links: DataFrame, sources: DataFrame, source_id: int) -> DataFrame:
    """The stored links of a source with their targets, nearest first."""
    targets = sources.select(F.col("id").alias("target_source_id"), "source_uid", "source_type", "label")
    mine = links.filter(F.col("source_id") == source_id).join(targets, "target_source_id")
    return mine.select("target_source_id", "source_uid", "source_type", "label", "distance", "method").orderBy("distance", "target_source_id").limit(SOURCE_LINK_LIMIT)


def list_sources(sources: DataFrame, source_atoms: DataFrame, indexes: DataFrame) -> DataFrame:
    """Sources, newest first, with their number of links and whether they have a centroid."""
    counts = source_atoms.groupBy("source_id").agg(F.count("*").cast("int").alias("atom_count"))
    out = sources.join(counts, sources["id"] == counts["source_id"], "left").drop("source_id")
    out = out.join(indexes.select("source_id", F.lit(True).alias("indexed")), out["id"] == F.col("source_id"), "left").drop("source_id")
    out = out.withColumns({"atom_count": F.coalesce("atom_count", F.lit(0)), "indexed": F.coalesce("indexed", F.lit(False))})
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(SOURCE_LIST_LIMIT)


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by source_uid: the type is overwritten, blank labels and locators keep the old ones,
    metadata is replaced only where given. A new row without a uid gets one."""
    filled = new.select(
        F.coalesce(F.nullif(trimmed(F.col("source_uid")), F.lit("")), F.lower(F.uuid())).alias("source_uid"), trimmed(F.col("source_type")).alias("n_type"),
        F.nullif(trimmed(F.col("label")), F.lit("")).alias("n_label"), F.nullif(trimmed(F.col("locator")), F.lit("")).alias("n_locator"), json_of(F.col("metadata")).alias("n_metadata"))
    both = old.join(filled, "source_uid", "full")
    return both.select(
        "source_uid", F.coalesce("n_type", "source_type").alias("source_type"), F.coalesce("n_label", "label").alias("label"),
        F.coalesce("n_locator", "locator").alias("locator"), F.coalesce("n_metadata", "metadata").alias("metadata"))


def link_atoms(links: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, atom_id, linked): every new pair once, linked if it wasn't there before."""
    pairs = new.select("source_id", "atom_id").distinct()
    old = links.select("source_id", "atom_id", F.lit(True).alias("old")).distinct()
    return pairs.join(old, ["source_id", "atom_id"], "left").select("source_id", "atom_id", F.col("old").isNull().alias("linked"))


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """All pairs after linking."""
    return links.select("source_id", "atom_id").union(new.select("source_id", "atom_id")).distinct()


def unlinked(links: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of ``links`` after the pairs of ``gone`` are unlinked."""
    return links.join(gone.select("source_id", "atom_id"), ["source_id", "atom_id"], "left_anti")


def returned(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The pairs that unlinking removes."""
    return links.join(gone.select("source_id", "atom_id"), ["source_id", "atom_id"], "left_semi")


def graph_without_empty(links: DataFrame, indexes: DataFrame) -> DataFrame:
    """Similarity links whose both ends still have a centroid."""
    alive = indexes.select("source_id")
    out = links.join(alive, "source_id", "left_semi")
    return out.join(alive.withColumnRenamed("source_id", "target_source_id"), "target_source_id", "left_semi")
