"""The changelog as a stream: folding pushes into current state as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changelog import current_state
from ..sources import files

KEYS = ["vault_id", "file_path"]
COLUMNS = [*KEYS, "base64", "content_sha256", "size_bytes", "is_deleted", "updated_unix_ms", "content_version", "last_change_id"]


def fold_stream(log: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Current state in a memory table: complete output, since late changes apply by arrival and no
    state may be dropped by a watermark. For checks and small vaults; :func:`fold_to` is for large ones."""
    return current_state(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_to(log: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Current state kept as Parquet under ``root`` in hashed buckets of files, one folder each; a
    manifest by batch names every bucket's folder.

    A batch reads and rewrites only the buckets that its changes fall into, in folders of its own,
    and then moves its manifest into place: readers see the state before or after, never between. A
    repeated batch starts from the manifest before it and does the same again. Folders that neither
    the new manifest nor the one before it names are removed, so a reader of the last but one isn't
    disturbed. Only the latest change of a file and its version count are kept: state grows with
    files, not with changes.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")
        new = current_state(batch).select(*COLUMNS, bucket)
        before, now = manifest(spark, root, n)
        # A name for each bucket that is touched; there are no more than ``buckets``.
        touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()]
        if not touched:
            return
        old = [f"{root}/{now[str(b)]}" for b in touched if str(b) in now]
        rows = new.drop("bucket")
        if old:
            # Of changes with one id the same counts as where they come in one batch.
            later = F.struct("last_change_id", -F.col("updated_unix_ms"), "content_sha256")
            rows = spark.read.parquet(*old).select(*COLUMNS).unionByName(rows).groupBy(*KEYS).agg(
                F.max_by(F.struct(*[c for c in COLUMNS[2:] if c != "content_version"]), later).alias("l"), F.sum("content_version").alias("content_version")
            ).select(*KEYS, "l.*", "content_version")
        rows = rows.select(*COLUMNS, bucket).repartition(min(len(touched), buckets), "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v{n:012d}")
        after = now | {str(b): f"v{n:012d}/bucket={b}" for b in touched}
        files.write_json(spark, f"{root}/manifest/{n:012d}.json", after)
        used = {*now.values(), *after.values()}
        for version in {p.split("/")[0] for p in (before or {}).values()}:
            for name in files.names(spark, f"{root}/{version}"):
                if name.startswith("bucket=") and f"{version}/{name}" not in used:
                    files.remove(spark, f"{root}/{version}/{name}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, root: str, below: int | None = None) -> tuple[dict[str, str] | None, dict[str, str]]:
    """The last but one and the last manifest (bucket to folder) under ``root``, of batches ``below`` a number."""
    found = [f for f in files.names(spark, f"{root}/manifest") if f.endswith(".json") and (below is None or int(f[:-5]) < below)]
    last = [files.read_json(spark, f"{root}/manifest/{f}") for f in found[-2:]]
    return (last[-2] if len(last) > 1 else None), (last[-1] if last else {})


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """Current state as the newest manifest names it; an error where no batch was folded yet."""
    folders = [f"{root}/{p}" for p in manifest(spark, root)[1].values()]
    if not folders:
        raise FileNotFoundError(f"no state under {root}")
    return spark.read.parquet(*folders).select(*COLUMNS)
