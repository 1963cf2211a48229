"""A push from end to end: changes appended to a vault's log, and all that is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import VECTOR_WIDTH
from ..sources.scratch import by_shuffle, stored
from . import changelog, notes
from .atoms import released_orphans
from .ids import numbered
from .neighbours import Index

KEYS = ["vault_id", "file_path"]


@dataclass
class Vaults:
    """What is stored between pushes: the log, similarity links and vectors of notes, atoms and what holds them."""

    log: DataFrame  # id, vault_id, file_path, action, changed_at_unix_ms, content_base64, content_sha256, size_bytes, device_id
    links: DataFrame  # file_a_id, file_b_id, similarity
    vectors: DataFrame  # id, vector_content
    atoms: DataFrame  # id, content, vector, type, parent, metadata
    file_atoms: DataFrame  # file_id, atom_id
    source_atoms: DataFrame  # source_id, atom_id


@dataclass
class Pushed:
    """The stored tables after a push, and what it did."""

    after: Vaults
    errors: DataFrame  # the changes that were left out, with error
    files: DataFrame  # state with id and text before notes are written back
    notes: DataFrame  # id, vault_id, file_path, title, summary, keypoints of the changed notes
    impacted: DataFrame  # id
    generated: DataFrame  # the changes that write notes back, as in the log
    jobs: DataFrame  # of all versions
    orphans: DataFrame  # atoms that the push removed


def file_ids(log: DataFrame) -> DataFrame:
    """(vault_id, file_path, id): a file is named by the id of its first change."""
    return log.groupBy(*KEYS).agg(F.min("id").alias("id"))


def files_of(log: DataFrame) -> DataFrame:
    """Current state with file ids and text."""
    return changelog.with_text(changelog.current_state(log).join(by_shuffle(file_ids(log)), KEYS))


def push(before: Vaults, changes: DataFrame, now_ms: int, width: int = VECTOR_WIDTH, index: Index | None = None) -> Pushed:
    """Apply ``changes`` (as a log, with ids above all others) to what is stored.

    Invalid changes are left out. The changed files lose their atoms; of those, atoms that nothing
    else holds go. Changed notes are parsed and embedded, their keypoints become atoms, and their
    links are found anew among their vaults' notes (by ``index``, one of the notes before, if given).
    Notes whose related ones changed are written back as generated changes, which follow in the log.
    Work grows with the changes and with what they touch, but for folding the log.
    """
    checked = changelog.normalised(changes, now_ms)
    good = stored(checked.filter("error is null").drop("error"), "push-changes")
    names = before.log.columns
    log = before.log.unionByName(good.select(*[c for c in good.columns if c in names]), allowMissingColumns=True)
    files = stored(files_of(log), "push-files")
    seeds = files.join(by_shuffle(good.select(*KEYS).distinct()), KEYS, "left_semi").select("id")

    released = stored(before.file_atoms.join(by_shuffle(seeds.withColumnRenamed("id", "file_id")), "file_id", "left_semi").select("file_id", "atom_id").distinct(), "push-released")
    some = by_shuffle(released.select("atom_id").distinct())
    held = before.file_atoms.join(some, "atom_id", "left_semi").select("atom_id", F.concat(F.lit("f"), "file_id").alias("by"))
    held = held.union(before.source_atoms.join(some, "atom_id", "left_semi").select("atom_id", F.concat(F.lit("s"), "source_id")))
    counts = held.distinct().groupBy("atom_id").agg(F.count("*").alias("holders"))
    orphans = stored(released_orphans(before.atoms, counts, released), "push-orphans")

    made = notes.process(files, seeds, before.links, before.vectors, width, now_ms, index)
    points = made["keypoints"].select("file_id", "keypoint_index", "content", "vector", F.lit("imported").alias("type"), "parent", "metadata")
    points = stored(numbered(points, ["file_id", "keypoint_index"], before.atoms), "push-atoms")
    atoms = before.atoms.join(by_shuffle(orphans.select("id")), "id", "left_anti").unionByName(points.select(*[c for c in before.atoms.columns if c in points.columns]), allowMissingColumns=True)
    file_atoms = before.file_atoms.join(by_shuffle(seeds.withColumnRenamed("id", "file_id")), "file_id", "left_anti").select("file_id", "atom_id").union(points.select("file_id", F.col("id").alias("atom_id")))
    generated = stored(numbered(made["changes"], KEYS, log.select("id")), "push-generated")
    vectors = before.vectors.join(by_shuffle(seeds), "id", "left_anti").select("id", "vector_content").unionByName(made["vectors"].select("id", "vector_content"))

    jobs = changelog.job_status(changelog.enqueued(log), files)
    done = jobs.join(by_shuffle(good.select(*KEYS, F.lit(True).alias("seed")).distinct()), KEYS, "left")
    jobs = done.withColumn("status", F.when(F.col("seed") & (F.col("status") == "pending"), "completed").otherwise(F.col("status"))).drop("seed")
    after = Vaults(log.unionByName(generated.select(*[c for c in generated.columns if c in names]), allowMissingColumns=True), made["links"], vectors, atoms, file_atoms, before.source_atoms)
    return Pushed(after, checked.filter("error is not null"), files, made["notes"], made["impacted"], generated, jobs, orphans)


def created(log: DataFrame, atoms: DataFrame, source_atoms: DataFrame, now_ms: int, width: int = VECTOR_WIDTH) -> Pushed:
    """Stored tables for a ``log`` whose files were never processed, as one push of all of it."""
    spark = log.sparkSession
    none = log.filter("false")
    ids = log.schema["id"].dataType.simpleString()
    before = Vaults(
        none, spark.createDataFrame([], f"file_a_id {ids}, file_b_id {ids}, similarity double"), spark.createDataFrame([], f"id {ids}, vector_content array<float>"), atoms,
        spark.createDataFrame([], f"file_id {ids}, atom_id long"), source_atoms)
    return push(before, log, now_ms, width)
