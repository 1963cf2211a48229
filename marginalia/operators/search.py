"""Nearest-neighbour searches over atoms and vault notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, link_target, trimmed
from ..functions.vectors import l2_distance, literal
from ..schema import FIND_LIMIT, SEARCH_LIMIT, clamp


def find(atoms: DataFrame, query: Sequence[float], limit: int = FIND_LIMIT) -> DataFrame:
    """The atoms nearest to a query vector, ties to the smaller id: id, text, metadata, distance.

    The query is a constant of the plan: one scan with a top-k in each task.
    """
    near = atoms.select("id", F.col("content").alias("text"), "metadata", l2_distance(F.col("vector"), literal(query)).alias("distance"))
    return near.filter(F.col("distance").isNotNull()).orderBy("distance", "id").limit(limit)


def is_note(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def search_vault(
    files: DataFrame, file_atoms: DataFrame, atoms: DataFrame, query: Sequence[float], limit: int | None = None, vault_id: int | None = None
) -> DataFrame:
    """Each live note's keypoint nearest to the query, nearest notes first, ties by path.

    Returns file_path, title, keypoint, distance, updated_unix_ms and obsidian_link. Distances are
    found before the join, so that vectors aren't shuffled; a note's best keypoint is a map-side
    minimum over (distance, atom id).
    """
    near = atoms.select(F.col("id").alias("atom_id"), F.col("content").alias("keypoint"), l2_distance(F.col("vector"), literal(query)).alias("distance"))
    live = files.filter(~F.col("is_deleted") & is_note(F.col("file_path")))
    if vault_id is not None:
        live = live.filter(F.col("vault_id") == vault_id)
    live = live.select(F.col("id").alias("file_id"), "file_path", "subject", "updated_unix_ms")
    links = file_atoms.select("file_id", "atom_id").join(live.select("file_id"), "file_id", "left_semi")
    best = links.join(near.filter(F.col("distance").isNotNull()), "atom_id").groupBy("file_id")
    best = best.agg(F.min(F.struct("distance", "atom_id", "keypoint")).alias("best"))
    title = F.coalesce(F.nullif(trimmed(F.col("subject")), F.lit("")), file_stem(F.col("file_path")))
    found = live.join(best, "file_id").select(
        "file_path", title.alias("title"), F.col("best.keypoint").alias("keypoint"), F.col("best.distance").alias("distance"),
        "updated_unix_ms", link_target(F.col("file_path")).alias("obsidian_link"))
    return found.orderBy("distance", "file_path").limit(clamp(limit, SEARCH_LIMIT))


def by_path(rows: DataFrame, path_col: str, part: str = "", suffix: str = "") -> DataFrame:
    """Rows whose path holds ``part`` and ends in ``suffix``, in any case; blank filters let all through."""
    path = F.lower(F.col(path_col))
    return rows.filter(F.contains(path, F.lit(part.strip().lower())) & path.endswith(suffix.strip().lower()))


def confidence(distance: Column) -> Column:
    """High up to 0.2, Medium up to 0.45, else Low; Unknown without a distance."""
    known = distance.isNotNull() & ~F.isnan(distance)
    return F.when(~known, "Unknown").when(distance <= 0.2, "High").when(distance <= 0.45, "Medium").otherwise("Low")


def unified(vault: DataFrame, memory: DataFrame | None, text: str) -> DataFrame:
    """Vault and memory hits as two ranked lists in one frame (origin, rank, label, distance).

    Queries of fewer than two characters find nothing. Hits without a distance come last.
    """
    parts = [vault.select(F.lit("vault").alias("origin"), F.col("file_path").alias("label"), "distance")]
    if memory is not None:
        parts.append(memory.select(F.lit("memory").alias("origin"), F.col("text").alias("label"), "distance"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if len(text.strip()) < 2:
        rows = rows.limit(0)
    order = Window.partitionBy("origin").orderBy(F.asc_nulls_last("distance"), "label")  # a few rows each: both lists are limited
    return rows.select("origin", F.row_number().over(order).alias("rank"), "label", "distance")
