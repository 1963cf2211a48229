"""Atoms: lookup, insertion, deletion, and pruning of orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..sources.scratch import by_shuffle
from .ids import numbered


def lookup(requests: DataFrame, atoms: DataFrame) -> DataFrame:
    """(request_id, atom_id) for requests with an id or a text; the id wins where both are given.

    Equal texts resolve to the smallest id; what isn't found has a null atom_id.
    """
    by_text = atoms.groupBy("content").agg(F.min("id").alias("text_id"))
    by_id = atoms.select(F.col("id").alias("atom_id"), F.lit(True).alias("there"))
    out = requests.withColumn("content", F.when(F.col("atom_id").isNull(), trimmed(F.col("atom_text"))))
    out = out.join(by_id, "atom_id", "left").join(by_text, "content", "left")
    return out.select("request_id", F.when(F.col("atom_id").isNotNull(), F.when(F.col("there"), F.col("atom_id"))).otherwise(F.col("text_id")).alias("atom_id"))


def insertable(texts: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distinct non-blank trimmed texts that no atom has yet; texts are told by 128 bits of hashes."""
    key = [F.xxhash64("content").alias("k1"), F.xxhash64(F.lit(1), F.col("content")).alias("k2")]
    fresh = texts.select(trimmed(F.col("content")).alias("content")).filter("content <> ''").select("content", *key)
    fresh = fresh.join(atoms.select(*key), ["k1", "k2"], "left_anti")
    return fresh.groupBy("k1", "k2").agg(F.min("content").alias("content")).select("content")


def inserted(texts: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, content) of all atoms after insertion; new ids follow the largest, in text order.

    Where no atom has an id yet, the first is 1.
    """
    old = atoms.select("id", "content")
    new = numbered(insertable(texts, atoms), ["content"], old)
    return old.unionByName(new.select("id", "content"))


def deleted_by_text(atoms: DataFrame, text: str) -> DataFrame:
    """Atoms without those of exactly this text; bridge rows stay as they are."""
    return atoms.filter(~F.col("content").eqNullSafe(text))


def orphans(atoms: DataFrame, file_atoms: DataFrame, source_atoms: DataFrame) -> DataFrame:
    """Imported or AI-made atoms that neither a file nor a source holds, over all vaults."""
    made = atoms.filter(F.col("type").isin("aicreated", "imported"))
    for links in (file_atoms, source_atoms):
        made = made.join(links.select(F.col("atom_id").alias("id")), "id", "left_anti")
    return made


def pruned(atoms: DataFrame, file_atoms: DataFrame, source_atoms: DataFrame) -> DataFrame:
    """Atoms without the orphans."""
    return atoms.join(orphans(atoms, file_atoms, source_atoms).select("id"), "id", "left_anti")


def holder_counts(file_atoms: DataFrame, source_atoms: DataFrame) -> DataFrame:
    """(atom_id, holders): how many links of files and sources hold each atom; a link that occurs twice counts once."""
    files = file_atoms.select("atom_id", F.col("file_id").alias("holder"), F.lit("f").alias("kind"))
    both = files.union(source_atoms.select("atom_id", F.col("source_id").alias("holder"), F.lit("s").alias("kind"))).distinct()
    return both.groupBy("atom_id").agg(F.count("*").alias("holders"))


def counts_after(counts: DataFrame, released: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """``counts`` (atom_id, holders) after links (atom_id, one row each) are ``released`` and ``added``; atoms that nothing holds stay, with 0."""
    change = released.groupBy("atom_id").agg(F.count("*").alias("n")).select("atom_id", (-F.col("n")).alias("n"))
    if added is not None:
        change = change.union(added.groupBy("atom_id").agg(F.count("*").alias("n")))
    rows = counts.select("atom_id", F.col("holders").alias("n")).union(change)
    return rows.groupBy("atom_id").agg(F.greatest(F.sum("n"), F.lit(0)).cast("long").alias("holders"))


def released_orphans(atoms: DataFrame, counts: DataFrame, released: DataFrame) -> DataFrame:
    """The orphans that a push makes: atoms of the ``released`` links (atom_id) which nothing else holds.

    ``counts`` are from before. Only atoms that were released are looked at; where all atoms without
    a holder were pruned before, these are all orphans that there are.
    """
    gone = released.groupBy("atom_id").agg(F.count("*").alias("n"))
    free = gone.join(by_shuffle(counts), "atom_id", "left").filter(F.coalesce("holders", F.lit(0)) <= F.col("n")).select(F.col("atom_id").alias("id"))
    return atoms.filter(F.col("type").isin("aicreated", "imported")).join(by_shuffle(free), "id", "left_semi")
