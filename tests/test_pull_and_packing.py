"""Paged pulls, parallel packing, centroids by deltas."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import packing, pull, sources

LOG = "id long, vault_id long, file_path string, action string, changed_at_unix_ms long, content_base64 string, content_sha256 string, size_bytes long, device_id string"
CLIENTS = "vault_id long, since_ms long, since_id long"
FILES = "vault_id long, path string, content_base64 string"


def log_of(spark, rows):
    return spark.createDataFrame([(i, v, p, a, t, f"c{i}", "h", 1, "d") for i, v, p, a, t in rows], LOG)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_mark_is_the_time_of_the_greatest_id(spark):
    log = log_of(spark, [(1, 1, "a", "modified", 100), (2, 1, "b", "modified", 50), (3, 2, "c", "modified", 7)])
    clients = spark.createDataFrame([(1, None, None), (2, 9, 1), (3, 5, 4)], CLIENTS)
    # Vault 1's latest arrival is older than another; vault 3 has no change and gives no mark.
    assert {tuple(r) for r in pull.marks(log, clients).collect()} == {(1, 50, 2), (2, 7, 3), (3, None, None)}


def test_late_arrivals(spark):
    log = log_of(spark, [(1, 1, "a", "modified", 100), (2, 1, "late", "modified", 50)])
    here = spark.createDataFrame([(1, "a", "c1")], FILES)
    clients = spark.createDataFrame([(1, 100, 1)], CLIENTS)
    assert [r[1] for r in rows(pull.pulled(here, log, clients)[0])] == ["a"]
    assert [r[1] for r in rows(pull.pulled(here, log, clients, safe=True)[0])] == ["a", "late"]


def test_pages_in_any_steps_equal_one_pull(spark):
    rng = random.Random(1)
    log = log_of(spark, [(i, rng.choice([1, 1, 1, 2]), f"p{rng.randrange(30)}", rng.choice(["modified", "modified", "deleted"]), rng.randrange(1000)) for i in range(1, 400)])
    here = spark.createDataFrame([(1, "p1", "old"), (1, "x", "old"), (2, "p2", "old")], FILES)
    clients = spark.createDataFrame([(1, 100, 0), (2, None, None)], CLIENTS)
    whole, _ = pull.pulled(here, log, clients)
    pages = pull.pages(log, clients, 17)
    sizes = {(r["vault_id"], r["page"]): r["count"] for r in pages.groupBy("vault_id", "page").count().collect()}
    last = max(p for _, p in sizes)
    assert set(sizes) == {(1, p) for p in range(last + 1)} and all(n == 17 for (_, p), n in sizes.items() if p < last)
    files = pull.snapshots(here, log, clients)
    for step in (pages.filter("page < 3"), pages.filter("page = 3"), pages.filter("page > 3")):
        files = pull.applied(files, step)
    assert rows(files) == rows(whole)
    assert pull.pages(log, clients.limit(0), 5).count() == 0


def greedy(sizes, overhead, limit):
    out, used, batch = [], limit, -1
    for n in sizes:
        if used + 1 + n > limit:
            used, batch = overhead + n, batch + 1
        else:
            used += 1 + n
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_of_a_vault_pack_as_one_sequence(block):
    """Summing up blocks and chaining the sums equals packing change by change."""
    rng = np.random.default_rng(block)
    for _ in range(30):
        limit, overhead = int(rng.integers(20, 200)), int(rng.integers(0, 10))
        sizes = rng.integers(0, limit - overhead + 1, 60)
        used, batch, got = limit, -1, []
        for at in range(0, len(sizes), block):
            part = sizes[at : at + block]
            got += packing.numbered(part, used, batch, overhead, limit).tolist()
            total, upto, begun, ends = packing.summed_up(part, overhead, limit)
            if used + total <= limit:
                used += total
            else:
                k = int(np.searchsorted(upto, used, side="left")) - 1
                used, batch = ends[k], batch + begun[k]
        assert got == greedy(sizes.tolist(), overhead, limit)


def test_hot_vault_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = random.Random(2)
    changes = [(1 if i % 4 else i % 9, i, rng.randrange(0, 300)) for i in range(2000)]
    df = spark.createDataFrame(changes, "vault_id long, seq long, bytes long").repartition(9)
    got = {(r["vault_id"], r["seq"]): r["batch"] for r in packing.upload_batches(df, 20, 1000).collect()}
    want = {}
    for v in {v for v, *_ in changes}:
        mine = sorted((s, n) for x, s, n in changes if x == v)
        want |= {(v, s): b for (s, _), b in zip(mine, greedy([n for _, n in mine], 20, 1000))}
    assert got == want
    assert packing.upload_batches(df.limit(0), 20, 1000).count() == 0


def test_unlinking_undoes_linking(spark):
    rng = np.random.default_rng(3)
    atoms = spark.createDataFrame([(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)], "id long, vector array<float>")
    pairs = lambda rows: spark.createDataFrame(rows, "source_id long, atom_id long")
    old = [(i % 4, i) for i in range(40)] + [(9, 1), (9, 99)]
    new = [(i % 5, i) for i in range(40, 60)]
    gone = [(9, 1), (2, 2), (2, 6)]
    sums = sources.centroid_sums(pairs(old), atoms)
    now = sources.centroid_sums_after(sums, atoms, pairs(new), pairs(gone))
    assert rows(now) == rows(sources.centroid_sums(pairs([p for p in old + new if p not in gone]), atoms))
    assert rows(sources.centroid_sums_after(now, atoms, pairs(gone), pairs(new))) == rows(sums)
    means = {r["source_id"]: r["embedding"] for r in sources.centroids(now).collect()}
    assert set(means) == {0, 1, 2, 3, 4}  # the source whose atoms are all gone has no centroid
    want = {r["source_id"]: r["embedding"] for r in sources.source_indexes(pairs([p for p in old + new if p not in gone]), atoms).collect()}
    assert all(np.allclose(means[k], want[k], atol=1e-9) for k in want)
