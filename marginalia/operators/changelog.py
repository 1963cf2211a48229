"""Vault changelog: normalising pushes, folding the log to current state, deltas, snapshots, jobs.

The log is append-only. State follows arrival (the change id); event times are the clients'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import action_of, digest_of, path_of, strict_base64, text_of
from ..schema import GENERATED_DEVICE, SYNC_LIMIT, clamp
from ..sources.scratch import by_shuffle
from .ids import placed


def normalised(changes: DataFrame, now_ms: int) -> DataFrame:
    """Pushed changes with a valid path, action and content, and an ``error`` for those that aren't.

    Added and modified changes need content (blank is an error); deletions have none. The digest is
    that of the bytes when the client sent none.
    """
    out = changes.withColumns({"file_path": path_of(F.col("file_path")), "action": action_of(F.col("action"))})
    out = out.withColumn("content", F.when(F.col("action") != "deleted", strict_base64(F.col("content_base64"))))
    blank = F.coalesce(F.col("content_base64"), F.lit("")) == ""
    error = (
        F.when(F.col("file_path").isNull(), "file_path")
        .when(F.col("action").isNull(), "action")
        .when((F.col("action") != "deleted") & blank, "content_base64 is required")
        .when((F.col("action") != "deleted") & F.col("content").isNull(), "content_base64")
    )
    gone = F.col("action") == "deleted"
    return out.select(
        *[c for c in changes.columns if c not in ("content_sha256", "changed_at_unix_ms", "content_base64", "size_bytes")],
        F.coalesce("changed_at_unix_ms", F.lit(now_ms)).alias("changed_at_unix_ms"), F.when(gone, "").otherwise(F.col("content_base64")).alias("content_base64"),
        F.when(gone, "").otherwise(F.coalesce("content_sha256", digest_of(F.col("content")))).alias("content_sha256"),
        F.when(gone, 0).otherwise(F.octet_length("content")).cast("long").alias("size_bytes"), error.alias("error"))


def current_state(log: DataFrame, keys: tuple[str, ...] = ("vault_id", "file_path")) -> DataFrame:
    """One row a file: the last change to arrive wins, whatever its time says.

    content_version counts the changes that clients made; changes that the engine generated move the
    body, size, time and last_change_id only. Deleted files keep a tombstone without content. Of changes
    with one id, which a sound log has none of, the earliest time counts, then the greatest ``copy`` where
    the log has that column, then the greatest digest as shown. A single map-side aggregation: a file with any number of changes sends one row from each task.
    """
    generated = F.coalesce(F.col("device_id"), F.lit("")) == GENERATED_DEVICE
    shown = F.when(F.col("action") == "deleted", "").otherwise(F.col("content_sha256"))
    first = F.struct("id", -F.col("changed_at_unix_ms"), *[c for c in ("copy",) if c in log.columns], shown, "action")
    last = F.max_by(F.struct("action", "changed_at_unix_ms", "content_base64", "content_sha256", "size_bytes", "id"), first)
    folded = log.groupBy(*keys).agg(last.alias("l"), F.count_if(~generated).alias("content_version"))
    gone = F.col("l.action") == "deleted"
    return folded.select(
        *keys, F.when(gone, "").otherwise(F.col("l.content_base64")).alias("base64"), F.when(gone, "").otherwise(F.col("l.content_sha256")).alias("content_sha256"),
        F.when(gone, 0).otherwise(F.col("l.size_bytes")).cast("long").alias("size_bytes"), gone.alias("is_deleted"),
        F.col("l.changed_at_unix_ms").alias("updated_unix_ms"), "content_version", F.col("l.id").alias("last_change_id"))


def with_derived(log: DataFrame, derived: DataFrame, keys: tuple[str, ...] = ("vault_id", "file_path")) -> DataFrame:
    """Current state with the columns derived from a file's text (``derived``: keys, derived_at_id, others).

    They are null from a client's change on until they are derived again; changes that the engine
    generated leave them alone. Deleted files have none.
    """
    mine = F.coalesce(F.col("device_id"), F.lit("")) != GENERATED_DEVICE
    client = log.filter(mine).groupBy(*keys).agg(F.max("id").alias("client_id"))
    both = current_state(log, keys).join(client, list(keys), "left").join(derived, list(keys), "left")
    fresh = ~F.col("is_deleted") & (F.coalesce("client_id", F.lit(-1)) <= F.col("derived_at_id"))
    names = [c for c in derived.columns if c not in (*keys, "derived_at_id")]
    return both.withColumns({c: F.when(fresh, F.col(c)) for c in names}).drop("client_id", "derived_at_id")


def pushed(log: DataFrame, changes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(state with text, jobs) after ``changes`` (with ids) are appended to ``log``; invalid ones are left out."""
    good = normalised(changes, now_ms).filter("error is null").drop("error")
    whole = log.select(*[c for c in good.columns if c in log.columns]).unionByName(good, allowMissingColumns=True)
    state = current_state(whole)
    return with_text(state), job_status(enqueued(whole), state)


def with_text(state: DataFrame) -> DataFrame:
    """State with the content as text where it looks like text."""
    return state.withColumn("content", F.when(~F.col("is_deleted"), text_of(F.unbase64("base64"))))


def delta_since(log: DataFrame, since_ms: int, limit: int | None = None, safe_after_id: int | None = None) -> DataFrame:
    """Changes later than a time, in order of (time, id); all of them, not the latest of each file.

    This order can miss changes that arrive late. ``safe_after_id`` pages on the id instead.
    """
    if safe_after_id is not None:
        return log.filter(F.col("id") > safe_after_id).orderBy("id").limit(clamp(limit, SYNC_LIMIT))
    return log.filter(F.col("changed_at_unix_ms") > since_ms).orderBy("changed_at_unix_ms", "id").limit(clamp(limit, SYNC_LIMIT))


def newest(log: DataFrame, n: int | None = None) -> DataFrame:
    """The newest changes, shown oldest first."""
    top = log.orderBy(F.desc("changed_at_unix_ms"), F.desc("id")).limit(clamp(n, SYNC_LIMIT))
    return top.orderBy("changed_at_unix_ms", "id")


def latest_change(log: DataFrame, *keys: str) -> DataFrame:
    """The change with the greatest id (not time) of each group: id and changed_at_unix_ms; of several with that id the earliest."""
    top = F.max_by("changed_at_unix_ms", F.struct("id", -F.col("changed_at_unix_ms")))
    return log.groupBy(*keys).agg(F.max("id").alias("latest_change_id"), top.alias("latest_change_unix_ms"))


def latest_generated(log: DataFrame, *keys: str) -> DataFrame:
    """The latest generated change by (time, id)."""
    mine = log.filter(F.col("device_id") == GENERATED_DEVICE)
    top = mine.groupBy(*keys).agg(F.max(F.struct("changed_at_unix_ms", "id")).alias("m"))
    return top.select(*keys, F.col("m.id").alias("latest_change_id"), F.col("m.changed_at_unix_ms").alias("latest_change_unix_ms"))


def live_snapshot(state: DataFrame, limit: int | None = None) -> DataFrame:
    """Files that exist, by path."""
    return state.filter(~F.col("is_deleted")).orderBy("vault_id", "file_path").limit(clamp(limit, SYNC_LIMIT))


def file_timestamps(state: DataFrame) -> DataFrame:
    """All files with their times and tombstones; the content column isn't read."""
    return state.select("vault_id", "file_path", "updated_unix_ms", "size_bytes", "is_deleted", "last_change_id")


def duplicate_paths(files: DataFrame, *keys: str) -> DataFrame:
    """Paths that a full push holds more than once, which rejects it."""
    return files.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def full_push(state: DataFrame, incoming: DataFrame, now_ms: int, keys: tuple[str, ...] = ("vault_id", "file_path")) -> DataFrame:
    """The changes that replace a vault's files by a snapshot.

    A file that is there is ``modified`` even if its bytes are the same, a new one ``added``; live
    files that weren't sent are ``deleted``. An empty snapshot deletes every file.
    """
    live = state.filter(~F.col("is_deleted")).select(*keys, F.lit(True).alias("live"))
    sent = incoming.select(*keys, "content_base64", F.lit(True).alias("sent"))
    both = live.join(sent, list(keys), "full")
    action = F.when(F.col("sent").isNull(), "deleted").when(F.col("live"), "modified").otherwise("added")
    return both.select(*keys, action.alias("action"), F.lit(now_ms).cast("long").alias("changed_at_unix_ms"), "content_base64")


def job_status(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Jobs as they stand: open ones of older versions of a file are superseded."""
    out = jobs.join(by_shuffle(state.select("vault_id", "file_path", "content_version")), ["vault_id", "file_path"])
    old = (F.col("file_version") < F.col("content_version")) & F.col("status").isin("pending", "running")
    return out.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("content_version")


#: What is queued for each version of a file.
JOB_TYPES = ["file_enrichment", "atomize"]


def enqueued(log: DataFrame) -> DataFrame:
    """Two jobs for each client change, by file version; a job that is there already isn't queued again."""
    mine = log.filter(F.coalesce(F.col("device_id"), F.lit("")) != GENERATED_DEVICE)
    versions = placed(mine.select("vault_id", "file_path", "id"), ["vault_id", "file_path"], ["id"])
    jobs = versions.select("vault_id", "file_path", (F.col("place") + 1).cast("long").alias("file_version"))
    return jobs.select("*", F.explode(F.array(*map(F.lit, JOB_TYPES))).alias("job_type"), F.lit("pending").alias("status"))


def finished(jobs: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Pending jobs completed; those of ``failed`` files failed, with one attempt more."""
    if failed is None:
        return jobs.withColumn("status", F.when(F.col("status") == "pending", "completed").otherwise(F.col("status")))
    marked = jobs.join(failed.select("vault_id", "file_path", "error"), ["vault_id", "file_path"], "left")
    hit = (F.col("status") == "pending") & F.col("error").isNotNull()
    return marked.withColumns({
        "status": F.when(hit, "failed").when(F.col("status") == "pending", "completed").otherwise(F.col("status")),
        "attempts": F.col("attempts") + hit.cast("int"), "last_error": F.when(hit, F.col("error")).otherwise(F.col("last_error"))}).drop("error")
