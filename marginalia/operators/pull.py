"""Pulls: what clients that hold copies of vaults take over from the log, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SYNC_LIMIT, clamp
from ..sources.scratch import stored
from .changelog import current_state, latest_change
from .ids import placed

KEYS = ["vault_id", "path"]


def pages(log: DataFrame, clients: DataFrame, limit: int | None = None, safe: bool = False) -> DataFrame:
    """The changes that ``clients`` (vault_id, since_ms, since_id) are due, with a page number from 0 for each vault.

    A client gets the changes later than ``since_ms``, in order of (time, id); or, if ``safe``, those
    that arrived after ``since_id``, in order of arrival, which misses none that arrives late. A page
    has ``limit`` changes. Vaults whose client holds no mark get none: they take the snapshot.
    Stored, so that a pull that was interrupted goes on where it stopped. A vault with any share of the
    log is spread.
    """
    due = F.col("id") > F.col("since_id") if safe else F.col("changed_at_unix_ms") > F.col("since_ms")
    order = ["id"] if safe else ["changed_at_unix_ms", "id"]
    rows = log.join(clients.select("vault_id", "since_ms", "since_id"), "vault_id").filter(due).drop("since_ms", "since_id")
    rows = placed(rows, ["vault_id"], order).withColumn("page", F.floor(F.col("place") / clamp(limit, SYNC_LIMIT)))
    return stored(rows.drop("place"), "pull-pages")


def applied(files: DataFrame, changes: DataFrame, order: tuple[str, ...] = ("changed_at_unix_ms", "id")) -> DataFrame:
    """(vault_id, path, content_base64) after changes (file_path): the last one of each path, in ``order``, decides."""
    last = changes.groupBy("vault_id", F.col("file_path").alias("path")).agg(F.max_by(F.struct("action", "content_base64"), F.struct(*order)).alias("l"))
    both = files.select(*KEYS, F.col("content_base64").alias("old")).join(last, KEYS, "full")
    keep = F.when(F.col("l").isNull(), F.col("old")).when(F.col("l.action") != "deleted", F.col("l.content_base64"))
    return both.select(*KEYS, keep.alias("content_base64")).filter("content_base64 is not null")


def snapshots(files: DataFrame, log: DataFrame, clients: DataFrame) -> DataFrame:
    """``files`` with those of clients without a mark replaced by their vaults' live files; other files of theirs go."""
    fresh = clients.filter("since_ms is null").select("vault_id")
    live = current_state(log.join(fresh, "vault_id", "left_semi")).filter(~F.col("is_deleted"))
    kept = files.join(fresh, "vault_id", "left_anti").select(*KEYS, "content_base64")
    return kept.unionByName(live.select("vault_id", F.col("file_path").alias("path"), F.col("base64").alias("content_base64")))


def marks(log: DataFrame, clients: DataFrame) -> DataFrame:
    """``clients`` after a pull: the id and the time of the change with the greatest id, not of the latest time.

    A vault without any change gives no mark, so that its next pull is a full one.
    """
    latest = latest_change(log, "vault_id")
    return clients.select("vault_id").join(latest, "vault_id", "left").select("vault_id", F.col("latest_change_unix_ms").alias("since_ms"), F.col("latest_change_id").alias("since_id"))


def pulled(files: DataFrame, log: DataFrame, clients: DataFrame, limit: int | None = None, safe: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, clients) after all vaults were pulled at once, to the last page.

    Changes that come while pages are taken wait for the next pull: all that is read is what the log
    holds when the pull begins.
    """
    todo = pages(log, clients, limit, safe)
    order = ("id",) if safe else ("changed_at_unix_ms", "id")
    return applied(snapshots(files, log, clients), todo, order), marks(log, clients)
