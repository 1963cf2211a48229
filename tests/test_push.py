"""Pushes from end to end, the metric index, and incremental orphans."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import atoms, changelog, neighbours, notes, push
from marginalia.plans import catalogue

NOTES = "id long, vault_id long, vector_content array<float>"


def clustered(n, clusters, spread, seed=1, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def frame(spark, x, vaults=2, start=0):
    return spark.createDataFrame([(start + i, (start + i) % vaults, v.astype(np.float32).tolist()) for i, v in enumerate(x)], NOTES)


def brute(x, vaults, radius, seeds=None):
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    i = np.arange(len(x))
    ok = (d <= radius) & (i[:, None] != i) & (i[:, None] % vaults == i % vaults)
    return {(a, b) for a, b in zip(*(v.tolist() for v in np.nonzero(ok))) if seeds is None or a in seeds}


def compared(met):
    return met.agg(F.coalesce(F.sum(F.col("n") * F.col("other_n")), F.lit(0))).first()[0]


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "CHUNK", 200)
    monkeypatch.setattr(neighbours, "SALT", 3)


@pytest.mark.parametrize(("clusters", "spread", "pruned"), [(12, 0.02, True), (900, 1.0, False)])
def test_tiles_that_hold_no_pair_are_skipped(spark, small_tiles, clusters, spread, pruned):
    x = clustered(900, clusters, spread)
    n = frame(spark, x)
    index = neighbours.metric_index(n)
    met = neighbours.meetings(index, None, 0.32).count()
    per_vault = [r["count"] for r in index.tiles.groupBy("vault_id").count().collect()]
    share = met / sum(t * (t + 1) // 2 for t in per_vault)
    assert share < 0.2 if pruned else share > 0.9, share
    got = {(r["id"], r["other"]) for r in neighbours.near(index, None, 0.32).collect()}
    assert got == brute(x, 2, 0.32)


def test_blocks_that_meet_many_are_not_shuffled(spark, small_tiles, monkeypatch):
    """What is shuffled for a pair of blocks is bounded by their tiles' number, not by their vectors."""
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    sizes = []
    for width in (16, 512):
        x = clustered(900, 900, 1.0, width=width)
        index = neighbours.metric_index(frame(spark, x))
        rows = neighbours.block_pairs(index, None, 1.3).toPandas()
        sizes.append(rows.astype(str).map(len).to_numpy().sum())
        assert len(rows) > 8 and set(rows.columns).isdisjoint({"codes", "flat", "ids"})
        assert {(r["id"], r["other"]) for r in neighbours.near(index, None, 1.3).collect()} == brute(x, 2, 1.3)
    assert sizes[1] < 1.5 * sizes[0]


def test_seeds_alone_are_searched_for(spark, small_tiles):
    """Pairs compared: seeds times their vaults at most, and no vault without a seed; stale vectors don't count."""
    x = clustered(600, 600, 1.0)
    every = frame(spark, x, vaults=3)
    index = neighbours.metric_index(every.filter("id < 590"))
    seeds = every.filter("id in (0, 3, 591, 594)")  # two known ones and two new ones, all of vault 0
    gone = spark.createDataFrame([(6,)], "id long")
    got = {(r["id"], r["other"]) for r in neighbours.near_seeds(seeds, index, 1.2, gone=gone).collect()}
    known = {i for i in range(590) if i != 6} | {0, 3, 591, 594}
    assert got == {(a, b) for a, b in brute(x, 3, 1.2, {0, 3, 591, 594}) if b in known} and got
    mine = neighbours.metric_index(seeds, index.pivots)
    assert compared(neighbours.meetings(mine, index, 1.2)) <= 4 * 200


def test_vaults_and_widths_that_the_index_does_not_know(spark):
    index = neighbours.metric_index(frame(spark, clustered(20, 2, 0.1), vaults=1))
    new = spark.createDataFrame([(100, 7, [1.0, 0.0]), (101, 7, [1.0, 0.01]), (102, 0, [1.0, 0.0])], NOTES)
    assert {(r["id"], r["other"]) for r in neighbours.near_seeds(new, index, 0.32).collect()} == {(100, 101), (101, 100)}
    assert neighbours.near_pairs(new.filter("id < 0"), 0.32).count() == 0


def test_copies_in_one_vault(spark, small_tiles):
    rows = [(i, 1, [1.0, 0.0, 0.0]) for i in range(100)]
    near = notes.neighbours(spark.createDataFrame(rows, NOTES))
    assert near.count() == 800 and near.filter("distance > 0").count() == 0
    assert [r["other"] for r in near.filter("id = 50").orderBy("rank").collect()] == list(range(8))


def test_tables_that_grow_are_not_broadcast(spark):
    n = frame(spark, clustered(60, 3, 0.05))
    near = notes.neighbours(n)
    links = notes.edges(near)
    files = n.select("id", "vault_id", F.concat(F.lit("n"), "id", F.lit(".md")).alias("file_path"), F.lit("x").alias("content"), F.lit(False).alias("is_deleted"))
    held = n.select(F.col("id").alias("atom_id"), F.lit(1).alias("holders"))
    made = n.select("id", F.lit("imported").alias("type"))
    for f in (near, notes.refreshed_edges(links, links, n), notes.impacted(n, links, links), notes.rewrites(files, links, n), atoms.released_orphans(made, held, held)):
        assert "Broadcast" not in f._jdf.queryExecution().executedPlan().toString()


LOG = "id long, vault_id long, file_path string, action string, changed_at_unix_ms long, content_base64 string, content_sha256 string, size_bytes long, device_id string"


def change(i, path, text, vault=1):
    body = None if text is None else base64.b64encode(text.encode()).decode()
    return (i, vault, path, "deleted" if text is None else "modified", i, body, None, None, "phone")


def test_push_on_what_is_stored(spark):
    atoms0 = spark.createDataFrame([(1, "mine", None, "usercreated", None, None)], "id long, content string, vector array<float>, type string, parent string, metadata string")
    links0 = spark.createDataFrame([], "source_id long, atom_id long")
    first = [change(1, "a.md", "# Shared beginning of all of these notes, 1"), change(2, "b.md", "# Shared beginning of all of these notes, 2"), change(3, "c.md", "- else"), change(4, "x.txt", "no note")]
    old = push.created(spark.createDataFrame(first, LOG), atoms0, links0, 5, 256)
    assert [(r["file_a_id"], r["file_b_id"]) for r in old.after.links.collect()] == [(1, 2)]
    assert {r["file_path"]: r["id"] for r in old.generated.collect()} == {"a.md": 5, "b.md": 6, "c.md": 7}
    assert old.after.atoms.count() == 4 and old.after.file_atoms.count() == 3
    text = {r["file_path"]: base64.b64decode(r["content_base64"]).decode() for r in old.generated.collect()}
    assert "- [[b]]" in text["a.md"] and text["c.md"] == "- else\n"

    before = old.after
    before.source_atoms = before.atoms.filter("content like '%else'").select(F.lit(9).cast("long").alias("source_id"), F.col("id").alias("atom_id"))
    second = [change(10, "b.md", None), change(11, "c.md", "- other"), change(12, "/bad", "x"), change(13, "d.md", "# Shared beginning of all of these notes, 6")]
    out = push.push(before, spark.createDataFrame(second, LOG), 6, 256)
    assert [r["error"] for r in out.errors.collect()] == ["file_path"]
    assert [(r["file_a_id"], r["file_b_id"]) for r in out.after.links.collect()] == [(1, 13)]
    assert {r["id"] for r in out.impacted.collect()} == {1, 2, 3, 13}
    now = {r["file_path"]: base64.b64decode(r["content_base64"]).decode() for r in out.generated.collect()}
    # The note that isn't pushed loses the link to the deleted one: its old block is replaced (it had one).
    assert set(now) == {"a.md", "c.md", "d.md"} and now["a.md"].count("related-links:start") == 1 and "- [[d]]" in now["a.md"] and "[[b]]" not in now["a.md"]
    assert sorted(r["content"] for r in out.orphans.collect()) == ["Shared beginning of all of these notes, 2"]  # the other is a source's, too
    assert {r["content"] for r in out.after.atoms.collect()} >= {"mine", "else", "other"}
    assert {(r["file_path"], r["file_version"], r["status"]) for r in out.jobs.collect() if r["file_path"] == "c.md"} == {("c.md", 1, "superseded"), ("c.md", 2, "completed")}
    state = changelog.current_state(out.after.log).filter("file_path = 'a.md'").first()
    assert state["content_version"] == 1 and state["last_change_id"] > 13
    assert {r["id"] for r in out.after.vectors.collect()} == {1, 3, 13}


def test_of_bodies_of_one_change_the_last_copy_counts(spark):
    rows = [(5, 1, f"{k}.md", "modified", 9, base64.b64encode(b"%d" % n).decode(), None, None, "phone", n) for k in range(9) for n in ((1, 2, 3) if k % 2 else (3, 1, 2))]
    log = spark.createDataFrame(rows, LOG + ", copy long").withColumn("content_sha256", F.sha2(F.unbase64("content_base64"), 256))
    state, _ = changelog.pushed(log, log.filter("false"), 5)
    assert {r["content"] for r in state.collect()} == {"3"}


def test_released_orphans_equal_all_orphans(spark):
    rng = np.random.default_rng(2)
    made = spark.createDataFrame([(i, ["usercreated", "imported", "aicreated"][i % 3]) for i in range(200)], "id long, type string")
    held = lambda n, name: spark.createDataFrame(list({(int(a), int(b)) for a, b in zip(rng.integers(0, 20, n), rng.integers(0, 200, n))}), f"{name} long, atom_id long")
    files, sources = held(300, "file_id"), held(100, "source_id")
    made = atoms.pruned(made, files, sources)
    counts = atoms.holder_counts(files, sources)
    released = files.filter("file_id < 7")
    left = files.filter("file_id >= 7")
    want = {r["id"] for r in atoms.orphans(made, left, sources).collect()}
    assert {r["id"] for r in atoms.released_orphans(made, counts, released).collect()} == want and want
    after = {(r["atom_id"], r["holders"]) for r in atoms.counts_after(counts, released).collect() if r["holders"]}
    assert after == {(r["atom_id"], r["holders"]) for r in atoms.holder_counts(left, sources).collect()}


def test_note_neighbours_query_has_rows(spark):
    assert catalogue.QUERIES["note_neighbors_top8"](spark, "/root/testdata/sf0.01").count() > 0


def test_nearest_of_copies_and_far_more_tiles(spark, small_tiles, monkeypatch):
    """Copies are searched for once, and ties go to smaller ids; vectors with entries that are no numbers are near nothing."""
    monkeypatch.setattr(neighbours, "BLOCK", 400)
    x = clustered(300, 40, 0.06)
    x = np.concatenate([x, np.repeat(x[:20], 30, axis=0)])
    extra = [(5000, 0, [float("nan")] + [0.0] * 15), (5001, 0, [float("inf")] + [0.0] * 15), (5002, 0, None)]
    n = frame(spark, x).union(spark.createDataFrame(extra, NOTES))
    wide = x.astype(np.float32).astype(float)
    d = np.sqrt(((wide[:, None] - wide[None]) ** 2).sum(axis=2))
    want = set()
    for i in range(len(x)):
        others = sorted((round(d[i, j], 12), j) for j in range(len(x)) if j != i and j % 2 == i % 2 and d[i, j] <= 0.32)
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(others[:8])}
    got = {(r["id"], r["other"], r["rank"]) for r in notes.neighbours(n).collect()}
    assert got == want
    some = n.withColumn("seed", F.col("id").isin(3, 4, 310))
    assert {(r["id"], r["other"], r["rank"]) for r in notes.neighbours(some).collect()} == {w for w in want if w[0] in (3, 4, 310)}


def test_the_search_within_a_vault_sends_codes_by_blocks(spark, monkeypatch):
    """A task holds a block's codes, one byte an entry, of a bounded number of chunks; chunks are bounded by their entries."""
    monkeypatch.setattr(neighbours, "CHUNK_CELLS", 1600)
    monkeypatch.setattr(neighbours, "TILE", 50)
    index = neighbours.metric_index(frame(spark, clustered(800, 800, 1.0), vaults=1))
    chunks = index.tiles.groupBy(F.shiftright("tile", 20)).agg(F.sum("n").alias("n")).toPandas()
    assert len(chunks) == 8 and chunks["n"].max() < 200
    assert all(r["size"] == 16 * r["n"] for r in index.tiles.select("n", F.length("codes").alias("size")).collect())
