"""Snapshot diffs: what changed locally, and against a server's file list; upload batches; applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an upload batch, by default and at least.
UPLOAD_BYTES, UPLOAD_LEAST = 8 << 20, 256 << 10


def classified(prefer_fingerprint: bool, prev: str = "prev", cur: str = "cur") -> Column:
    """changed, unchanged or uncertain, from two snapshot structs of one path (prev may be null)."""
    p, c = (lambda n: F.col(f"{prev}.{n}")), (lambda n: F.col(f"{cur}.{n}"))
    same = lambda n: p(n).eqNullSafe(c(n))
    both = p("content_fingerprint").isNotNull() & c("content_fingerprint").isNotNull()
    out = F.when(F.col(prev).isNull() | ~same("size_bytes") | ~same("modified_unix_ms"), "changed")
    out = out.when(both, F.when(p("content_fingerprint") == c("content_fingerprint"), "unchanged").otherwise("changed"))
    if prefer_fingerprint:
        out = out.when(~same("content_fingerprint"), "uncertain")
    return out.otherwise("unchanged")


def _packed(snapshot: DataFrame, name: str) -> DataFrame:
    return snapshot.select("path", F.struct("size_bytes", "modified_unix_ms", "content_fingerprint").alias(name))


def local_diff(previous: DataFrame, current: DataFrame, now_ms: int, prefer_fingerprint: bool = False) -> DataFrame:
    """(path, action, changed_at_unix_ms) between two local snapshots."""
    both = _packed(previous, "prev").join(_packed(current, "cur"), "path", "full")
    action = F.when(F.col("cur").isNull(), "deleted").when(F.col("prev").isNull(), "added").when(classified(prefer_fingerprint) != "unchanged", "modified")
    out = both.select("path", action.alias("action"), F.coalesce("cur.modified_unix_ms", F.lit(now_ms)).alias("changed_at_unix_ms"))
    return out.filter("action is not null")


def remote_diff(
    local: DataFrame, previous: DataFrame, remote: DataFrame, now_ms: int, mirror: bool = False, prefer_fingerprint: bool = False, strict_mirror: bool = False
) -> DataFrame:
    """(path, action, changed_at_unix_ms) to bring a server's files (path, updated_unix_ms, size_bytes,
    is_deleted) to the local ones. Without ``mirror``, files that the server has newer are left alone.
    ``strict_mirror`` deletes remote files that were never seen here, too."""
    there = remote.select("path", F.struct(F.coalesce("updated_unix_ms", F.lit(0)).alias("updated"), F.coalesce("size_bytes", F.lit(0)).alias("size"), F.coalesce("is_deleted", F.lit(False)).alias("gone")).alias("r"))
    rows = _packed(local, "cur").join(_packed(previous, "prev"), "path", "full").join(there, "path", "full")
    rows = rows.withColumn("cls", F.when(F.col("cur").isNotNull(), classified(prefer_fingerprint)))
    here, known = F.col("cur").isNotNull(), F.col("r").isNotNull()
    mtime, size = F.coalesce("cur.modified_unix_ms", F.lit(0)), F.coalesce("cur.size_bytes", F.lit(0))
    upload = (
        (F.col("cls") == "changed") | ((F.col("cls") == "uncertain") & (mtime >= F.col("r.updated"))) | (mtime > F.col("r.updated"))
        | (size != F.col("r.size")) | (F.lit(mirror) & (mtime != F.col("r.updated")))
    )
    stale = ~F.lit(mirror) & (mtime < F.col("r.updated")) & (F.col("cls") == "unchanged")
    action = (
        F.when(here & ~known, "added")
        .when(here & F.col("r.gone"), F.when(F.lit(mirror) | (F.col("cls") == "changed"), "added"))
        .when(here & stale, None)
        .when(here & upload, "modified")
        .when(~here & known & ~F.col("r.gone") & (F.lit(mirror or strict_mirror) | F.col("prev").isNotNull()), "deleted")
    )
    time = F.when(F.col("action") == "added", F.col("cur.modified_unix_ms")).when(F.col("action") == "modified", mtime).otherwise(now_ms)
    return rows.withColumn("action", action).filter("action is not null").select("path", "action", time.alias("changed_at_unix_ms"))


def full_push_plan(
    local: DataFrame, previous: DataFrame, remote: DataFrame | None, now_ms: int, body_bytes: int, limit: int = UPLOAD_BYTES, prefer_fingerprint: bool = False
) -> DataFrame | None:
    """None if a full push's body fits the limit; else the changes of a strict mirror diff, to be sent in batches.

    Without ``remote``, where the server's status can't be had, the changes since the previous snapshot.
    """
    if body_bytes <= max(limit, UPLOAD_LEAST):
        return None
    if remote is None:
        return local_diff(previous, local, now_ms, prefer_fingerprint)
    return remote_diff(local, previous, remote, now_ms, mirror=True, prefer_fingerprint=prefer_fingerprint, strict_mirror=True)


def upload_limit(asked: Column) -> Column:
    """Bytes of an upload batch: the default where nothing is asked, and never below the floor."""
    return F.greatest(F.coalesce(asked, F.lit(UPLOAD_BYTES)), F.lit(UPLOAD_LEAST)).cast("long")


def encoded_size(changes: DataFrame) -> DataFrame:
    """Each change with the bytes of its compact JSON (fields without a value left out)."""
    fields = [c for c in changes.columns if c not in ("vault_id", "seq")]
    return changes.withColumn("bytes", F.octet_length(F.to_json(F.struct(*fields))).cast("long"))


def without_content(changes: DataFrame) -> DataFrame:
    """Added and modified changes that an upload must reject, for want of content."""
    return changes.filter(F.lower("action").isin("added", "modified") & (F.trim(F.coalesce("content_base64", F.lit(""))) == ""))


def applied(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, content_base64) after a delta: the last change of each path by (time, id) decides."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("action", "content_base64"), F.struct("changed_at_unix_ms", "id")).alias("l"))
    both = files.select("path", F.col("content_base64").alias("old")).join(last, "path", "full")
    keep = F.when(F.col("l").isNull(), F.col("old")).when(F.col("l.action") != "deleted", F.col("l.content_base64"))
    return both.select("path", keep.alias("content_base64")).filter("content_base64 is not null")
