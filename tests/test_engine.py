"""Fixtures for single operators."""

import base64
import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions import embedding, text, vectors
from marginalia.operators import atoms, auth, changelog, notes, packing, search, snapshot, sources
from marginalia.sources import directory, payloads, state
from marginalia.streaming import vault_stream


def values(frame, column):
    return [r[column] for r in frame.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_embedding_of_ab(spark):
    t = spark.createDataFrame([(1, "ab"), (2, "  "), (3, None)], "id long, t string")
    got = {r["id"]: r["vector"] for r in embedding.embed(t, "id", "t", 16).collect()}
    sums = [27, -63, 0, 0, 0, 0, 0, -77, 0, 62, -26, 33, -26, -58, -121, -26]
    size = math.sqrt(sum(x * x for x in sums))
    assert got[1] == pytest.approx([x / size for x in sums])
    assert got[2] == [0.0] * 16 and got[3] == [0.0] * 16


def test_embedding_does_not_depend_on_partitions(spark):
    t = spark.createDataFrame([(i, f"text {i} é😀") for i in range(20)], "id long, t string")
    rows = lambda n: sorted((r["id"], tuple(r["vector"])) for r in embedding.embed(t.repartition(n), "id", "t", 32).collect())
    assert rows(1) == rows(7)


def test_outside_provider(spark):
    t = spark.createDataFrame([(1, "abc"), (2, " ")], "id long, t string")
    got = {r["id"]: r["vector"] for r in embedding.embed_with(t, "id", "t", 3, lambda texts: [[3.0, 4.0] for _ in texts]).collect()}
    assert got[1] == pytest.approx([0.6, 0.8, 0.0]) and got[2] == [0.0, 0.0, 0.0]


def test_settings():
    assert embedding.resolve_settings({"a": " ", "embedding_api_key": ""}, {"a": "x", "embedding_api_key": "k"}) == {"a": "x", "embedding_api_key": ""}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a\\b/./c.md", "a/b/c.md"), ("/x", None), ("a/../b", None), ("  ", None), ("a\0b", None), ("x" * 2049, None), (" ok.md ", "ok.md"), ("./.", None)],
)
def test_paths(spark, raw, want):
    assert one(spark, text.path_of(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("a/b", None), ("..", None), ("v" * 256, None), (" v ", "v")])
def test_vault_uid(spark, raw, want):
    assert one(spark, text.vault_uid_of(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [(" Created ", "added"), ("UPDATE", "modified"), ("removed", "deleted"), ("x", None)])
def test_actions(spark, raw, want):
    assert one(spark, text.action_of(F.lit(raw))) == want


@pytest.mark.parametrize(("data", "want"), [(b"", ""), (b"\0" + b"a" * 19, "\0" + "a" * 19), (b"\0\0" + b"a" * 18, None), (b"\xff\xfe", None)])
def test_text_sniff(spark, data, want):
    assert one(spark, text.text_of(F.lit(data))) == want


@pytest.mark.parametrize(("raw", "want"), [('{"a":1}', '{"a":1}'), ("hello", '"hello"'), ("  ", None), ("5", '"5"')])
def test_json(spark, raw, want):
    assert one(spark, text.json_of(F.lit(raw))) == want


def test_scalars(spark):
    assert one(spark, text.nfc(F.lit("é"))) == "é"
    assert one(spark, text.fnv1a64(F.lit(b"hello"))) == "a430d84680aabd0b"
    assert one(spark, text.strict_base64(F.lit("aGk"))) is None
    assert bytes(one(spark, text.strict_base64(F.lit("aGk=")))) == b"hi"
    assert one(spark, text.trimmed(F.lit(" \t a \n"))) == "a"
    assert one(spark, text.inline_normalised(F.lit("[[T|A]] ![[B]] `c` **d**"))) == "A B c d"
    assert one(spark, auth.verifies(auth.salted(F.lit("s"), F.lit("k")), F.lit("k"))) is True
    assert one(spark, auth.verifies(F.lit("broken"), F.lit("k"))) is False
    assert one(spark, vectors.to_literal(vectors.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))))) == "[0.60000000,0.80000000]"
    assert one(spark, vectors.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


LOG = "id long, vault_id long, file_path string, action string, changed_at_unix_ms long, content_base64 string, content_sha256 string, size_bytes long, device_id string"


def log_of(spark, rows):
    return spark.createDataFrame([(i, 1, p, a, t, "eA==", "h", 1, d) for i, p, a, t, d in rows], LOG)


def test_fold_follows_arrival(spark):
    log = log_of(spark, [(1, "a.md", "modified", 10, "d"), (2, "a.md", "modified", 5, "d"), (3, "b.md", "added", 1, "d"), (4, "b.md", "deleted", 2, "d"), (5, "a.md", "modified", 99, "generated")])
    got = {r["file_path"]: r for r in changelog.current_state(log).collect()}
    assert got["a.md"]["last_change_id"] == 5 and got["a.md"]["content_version"] == 2
    assert got["b.md"]["is_deleted"] and got["b.md"]["base64"] == "" and got["b.md"]["size_bytes"] == 0
    early = log.filter("id < 3")
    assert values(changelog.delta_since(early, 7), "id") == [1]
    assert values(changelog.delta_since(early, 7, safe_after_id=1), "id") == [2]
    assert changelog.latest_change(early, "vault_id").first()["latest_change_unix_ms"] == 5


def test_full_push(spark):
    state = changelog.current_state(log_of(spark, [(1, "a", "added", 1, "d"), (2, "b", "added", 1, "d")]))
    sent = spark.createDataFrame([(1, "b", "eA=="), (1, "c", "eA==")], "vault_id long, file_path string, content_base64 string")
    assert {(r["file_path"], r["action"]) for r in changelog.full_push(state, sent, 9).collect()} == {("a", "deleted"), ("b", "modified"), ("c", "added")}
    assert values(changelog.full_push(state, sent.limit(0), 9), "action") == ["deleted", "deleted"]


def test_push_errors(spark):
    rows = [("a.md", "modified", "", None, None), ("a.md", "deleted", None, None, None), ("/a", "added", "eA==", None, None), ("a.md", "x", "eA==", None, None), ("a.md", "added", "e A=", None, 4)]
    got = changelog.normalised(spark.createDataFrame(rows, "file_path string, action string, content_base64 string, content_sha256 string, changed_at_unix_ms long"), 7).collect()
    assert [r["error"] for r in got] == ["content_base64 is required", None, "file_path", "action", "content_base64"]


SNAP = "path string, size_bytes long, modified_unix_ms long, content_fingerprint string"
REMOTE = "path string, updated_unix_ms long, size_bytes long, is_deleted boolean"


@pytest.mark.parametrize(
    ("local", "previous", "remote", "mirror", "want"),
    [
        ((1, 5, "f"), None, None, False, "added"),
        ((1, 5, "f"), None, (5, 1, True), False, "added"),
        ((1, 5, "f"), (1, 5, "f"), (5, 1, True), True, "added"),
        ((1, 5, "f"), (1, 5, "f"), (5, 1, True), False, None),
        ((1, 5, "f"), (1, 5, "f"), (9, 2, False), False, None),
        ((1, 5, "f"), (1, 4, "f"), (9, 1, False), False, "modified"),
        ((1, 5, "f"), (1, 5, None), (5, 1, False), False, "modified"),
        ((1, 5, "f"), (1, 5, None), (6, 1, False), False, None),
        ((1, 5, "f"), (1, 5, "f"), (4, 1, False), False, "modified"),
        ((1, 5, "f"), (1, 5, "f"), (5, 2, False), False, "modified"),
        ((1, 5, "f"), (1, 5, "f"), (6, 1, False), True, "modified"),
        ((1, 5, "f"), (1, 5, "f"), (5, 1, False), False, None),
        (None, (1, 5, "f"), (5, 1, False), False, "deleted"),
        (None, None, (5, 1, False), True, "deleted"),
        (None, None, (5, 1, False), False, None),
    ],
)
def test_remote_truth_table(spark, local, previous, remote, mirror, want):
    frame = lambda row, ddl: spark.createDataFrame([("p", *row)] if row else [], ddl)
    got = snapshot.remote_diff(frame(local, SNAP), frame(previous, SNAP), frame(remote, REMOTE), 77, mirror, prefer_fingerprint=True)
    assert values(got, "action") == ([want] if want else [])


def test_upload_batches(spark):
    t = spark.createDataFrame([(1, i, 10) for i in range(5)] + [(2, 0, 10)], "vault_id long, seq long, bytes long")
    got = sorted((r["vault_id"], r["seq"], r["batch"]) for r in packing.upload_batches(t, 5, 26).collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 0, 0)]
    with pytest.raises(Exception, match="exceeds"):
        packing.upload_batches(t, 5, 12).collect()


def test_diff_then_apply_gives_the_target(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_base64 string")
    changes = spark.createDataFrame([("a", "deleted", None, 1, 1), ("c", "added", "3", 1, 2), ("b", "modified", "4", 1, 3)], "path string, action string, content_base64 string, changed_at_unix_ms long, id long")
    assert {tuple(r) for r in snapshot.applied(files, changes).collect()} == {("b", "4"), ("c", "3")}


def test_neighbours(spark):
    # One note in the middle, ten others 0.1 away in as many directions, one 0.33 away.
    unit = lambda k, r: [r if i == k else 0.0 for i in range(12)]
    rows = [(0, 1, unit(0, 0.0))] + [(k, 1, unit(k, 0.1)) for k in range(1, 11)] + [(11, 1, unit(11, 0.33)), (12, 2, unit(0, 0.0))]
    n = spark.createDataFrame(rows, "id long, vault_id long, vector_content array<double>")
    near = notes.neighbours(n).filter("id = 0").orderBy("rank").collect()
    assert [r["other"] for r in near] == list(range(1, 9))
    assert notes.edges(notes.neighbours(n)).filter("file_a_id = 0").first()["similarity"] == pytest.approx(0.9)


def test_near_pairs_equal_all_pairs(spark):
    import random

    random.seed(3)
    pts = [(i, i % 2, [random.random() for _ in range(3)]) for i in range(120)]
    n = spark.createDataFrame(pts, "id long, vault_id long, vector_content array<double>")
    got = {(r["id"], r["other"]) for r in notes.near_pairs(n, 0.3).collect()}
    assert got == {(a, b) for a, va, x in pts for b, vb, y in pts if a != b and va == vb and math.dist(x, y) <= 0.3}


def test_orphans(spark):
    a = spark.createDataFrame([(1, "usercreated"), (2, "imported"), (3, "imported")], "id long, type string")
    links = spark.createDataFrame([(9, 3)], "source_id long, atom_id long")
    assert values(atoms.orphans(a, links.filter("false").withColumnRenamed("source_id", "file_id"), links), "id") == [2]


def test_centroids(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    links = spark.createDataFrame([(7, 1), (7, 2), (7, 99), (8, 99)], "source_id long, atom_id long")
    assert [tuple(r) for r in sources.source_indexes(links, a).collect()] == [(7, [0.5, 0.5], 2)]
    assert {tuple(r) for r in sources.atom_counts(links, a).collect()} == {(7, 3, 2), (8, 1, 0)}
    assert sources.find_similar(sources.source_indexes(links, a), 8).count() == 0


def test_confidence_and_short_queries(spark):
    assert one(spark, search.confidence(F.lit(None).cast("double"))) == "Unknown"
    hits = spark.createDataFrame([("a", 0.1)], "file_path string, distance double")
    assert search.unified(hits, None, "x").count() == 0


def test_process_pipeline(spark):
    rows = [(1, 1, "a.md", "# Shared prefix of a note\n", False), (2, 1, "b.md", "# Shared prefix of a note!\n", False), (3, 1, "c.md", "# Something else\n", False)]
    files = spark.createDataFrame(rows, "id long, vault_id long, file_path string, content string, is_deleted boolean")
    empty = spark.createDataFrame([], "file_a_id long, file_b_id long, similarity double")
    none = spark.createDataFrame([], "id long, vector_content array<float>")
    out = notes.process(files, files.select("id"), empty, none, 256, 5)
    links = [(r["file_a_id"], r["file_b_id"]) for r in out["links"].collect()]
    assert links == [(1, 2)]
    changed = {r["file_path"]: base64.b64decode(r["content_base64"]).decode() for r in out["changes"].collect()}
    assert set(changed) == {"a.md", "b.md"} and "- [[b]]" in changed["a.md"]
    assert out["keypoints"].count() == 3


def test_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"vaultUid":"v","changes":[{"file_path":"a","filePath":"b","action":"added"},{"filePath":"c"}]}\n')
    got = payloads.read_pushes(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["vault_uid"], r["file_path"]) for r in got] == [("v", "a"), ("v", "c")]


def test_folders(spark, tmp_path):
    root = tmp_path / "in"
    (root / "d").mkdir(parents=True)
    (root / ".sync-state").mkdir()
    (root / "d" / "a.md").write_bytes(b"hello")
    (root / ".sync-state" / "s").write_bytes(b"x")
    snap = directory.snapshot(directory.read_folder(spark, str(root))).collect()
    assert [(r["path"], r["size_bytes"], r["content_fingerprint"]) for r in snap] == [("d/a.md", 5, "a430d84680aabd0b")]
    files = spark.createDataFrame([("x/y.md", bytearray(b"1"))], "path string, content binary")
    assert directory.mirror(spark, files, str(tmp_path / "out")) == 1
    (tmp_path / "out" / "z").write_bytes(b"2")
    directory.mirror(spark, files, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")) == ["y.md"]


def test_state_files(spark):
    rows = [("v", "{broken"), ("v", '{"vault_uid":"other","local_snapshot":{"a":{}}}'), ("v", None), ("v", '{"vault_uid":"v","local_snapshot":{"a":{"size_bytes":1}},"last_server_change_id":4}')]
    got = state.client_states(spark.createDataFrame(rows, "vault_uid string, state string")).collect()
    assert [(r["fresh"], len(r["local_snapshot"]), r["last_server_change_id"]) for r in got] == [(True, 0, None)] * 3 + [(False, 1, 4)]
    assert state.first_table(spark) is None or isinstance(state.first_table(spark), str)
    spark.range(1).createOrReplaceTempView("aaa_probe")
    assert state.first_table(spark) == "aaa_probe"
    spark.catalog.dropTempView("aaa_probe")


def test_stream_equals_batch(spark, tmp_path):
    log = log_of(spark, [(i, f"{i % 3}.md", "deleted" if i % 7 == 0 else "modified", 100 - i, "generated" if i % 5 == 0 else "d") for i in range(1, 40)])
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    vault_stream.fold_to(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = vault_stream.read_state(spark, str(tmp_path / "state"))
    want = changelog.current_state(log).select(*got.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    memory = vault_stream.fold_stream(stream, str(tmp_path / "cp2"), "folded")
    memory.awaitTermination()
    assert {tuple(r) for r in spark.table("folded").select(*got.columns).collect()} == {tuple(r) for r in want.collect()}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    root, cp, src = (str(tmp_path / n) for n in ("state", "cp", "log"))
    schema = log_of(spark, []).schema

    def fold(rows):
        log_of(spark, rows).coalesce(1).write.mode("append").parquet(src)
        vault_stream.fold_to(spark.readStream.schema(schema).parquet(src), root, cp, buckets=8).awaitTermination()
        return vault_stream.manifest(spark, root)[1]

    first = fold([(i, f"{i}.md", "modified", i, "d") for i in range(1, 60)])
    assert len(first) == 8
    stamps = {p: (tmp_path / "state" / p).stat().st_mtime_ns for p in first.values()}
    second = fold([(100, "7.md", "deleted", 1, "d"), (101, "7.md", "modified", 1, "d")])
    changed = [b for b in first if first[b] != second[b]]
    assert len(changed) == 1 and all((tmp_path / "state" / p).stat().st_mtime_ns == stamps[p] for b, p in second.items() if b not in changed)
    assert (tmp_path / "state" / first[changed[0]]).exists()  # a reader of the state before may still be at it
    third = fold([(200, "7.md", "modified", 1, "d")])
    assert not (tmp_path / "state" / first[changed[0]]).exists() and third[changed[0]] != second[changed[0]]
    state = {r["file_path"]: r for r in vault_stream.read_state(spark, root).collect()}
    assert len(state) == 59 and state["7.md"]["content_version"] == 4 and state["7.md"]["last_change_id"] == 200


@pytest.mark.parametrize("late", [1, 2])
def test_a_recurring_id_is_decided_alike_in_one_batch_and_in_two(spark, tmp_path, late):
    rows = [(7, f"{i}.md", "modified", t, "d") for i in range(20) for t in (10 + i % 2, 11 - i % 2)]
    src, schema = str(tmp_path / "log"), log_of(spark, []).schema
    for part in (rows[late - 1 :: 2], rows[2 - late :: 2]):
        log_of(spark, part).coalesce(1).write.mode("append").parquet(src)
        vault_stream.fold_to(spark.readStream.schema(schema).parquet(src), str(tmp_path / "state"), str(tmp_path / "cp"), buckets=2).awaitTermination()
    got = vault_stream.read_state(spark, str(tmp_path / "state"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in changelog.current_state(log_of(spark, rows)).select(*got.columns).collect()}
    assert {r["updated_unix_ms"] for r in got.collect()} == {10}


def test_fingerprints_in_pieces():
    import numpy as np

    def slow(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 255, 70_000, 140_001):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert text.fnv1a64_of(data) == slow(data)
        state = text.FNV_START
        for at in range(0, n, 999):
            state = text.fnv1a64_of(data[at : at + 999], state)
        assert state == slow(data)


def test_scan_goes_on_past_unreadable_files(spark, tmp_path):
    files = spark.createDataFrame([(f"d{i % 2}/{i}.md", bytearray(b"x" * i)) for i in range(20)] + [("big", bytearray(b"ab" * 2_000_000)), (".sync-state/s", bytearray(b"1"))], "path string, content binary")
    assert directory.written(files, str(tmp_path)) == 22
    names = directory.listed(spark, str(tmp_path)).collect()
    (tmp_path / "d1" / "7.md").unlink()
    got = {r["path"]: r for r in directory.scanned(spark.createDataFrame(names), str(tmp_path)).collect()}
    assert len(got) == 21 and [p for p, r in got.items() if r["warning"]] == ["d1/7.md"] and got["d1/7.md"]["content_fingerprint"] is None
    assert all(r["content_fingerprint"] == f"{text.fnv1a64_of(b'ab' * 2_000_000 if p == 'big' else b'x' * int(p[3:-3])):016x}" for p, r in got.items() if not r["warning"])
    assert got["d0/0.md"]["size_bytes"] == 0
    changes = spark.createDataFrame([("big", "deleted", None), ("d0/2.md", "modified", bytearray(b"new")), ("gone", "deleted", None)], "path string, action string, content binary")
    directory.applied(changes, str(tmp_path))
    assert not (tmp_path / "big").exists() and (tmp_path / "d0" / "2.md").read_bytes() == b"new"
    with pytest.raises(Exception, match="leaves"):
        directory.written(spark.createDataFrame([("../x", bytearray(b"1"))], "path string, content binary"), str(tmp_path))


def test_literals_round_as_c_does(spark):
    """Halves to the even digit, by exact values; numbers that aren't finite in C's spelling."""
    xs = [1 / 512, -3 / 512, 5 / 512, 0.1, -1e-10, 1234.0078125, float("nan"), float("inf"), float("-inf")]
    got = one(spark, vectors.to_literal(F.array(*map(F.lit, xs))))
    assert got == "[" + ",".join("%.8f" % x for x in xs) + "]"


def test_cheap_rounding(spark):
    xs = [0.1234565, -0.1234565, 0.5e-6, -0.4e-6, 0.0, 12.3456789]
    got = [one(spark, vectors.rounded(F.lit(x), 6)) for x in xs]
    assert got == [math.copysign(math.floor(abs(x) * 1e6 + 0.5), x) / 1e6 for x in xs]


def test_digests_of_low_positions_are_kept_and_others_found(monkeypatch):
    import hashlib

    import numpy as np

    from marginalia.functions import embedding

    monkeypatch.setattr(embedding, "POSITIONS", 8)
    monkeypatch.setattr(embedding, "_kept", {})
    texts = ["plain text", "", "é漢 text of more", "plain"]
    for _ in range(2):
        sums, _ = embedding._sums(texts, 16)
        for t, s in zip(texts, sums):
            want = np.zeros(16)
            for i, c in enumerate(t):
                h = hashlib.sha256(f"{i}:{ord(c)}".encode()).digest()
                for o in range(8):
                    want[(h[o] + 31 * i + 17 * o) % 16] += (1 if (h[o] ^ o) & 1 == 0 else -1) * (h[o] % 64 + 1) / 64
            assert np.array_equal(s, want)
    assert embedding._kept["known"].any()


def test_of_changes_with_one_id_the_earliest_counts(spark):
    """However the rows come; the number of changes stays."""
    rows = [(9, 1, "a", "modified", ms, "eA==", f"s{ms}", 1, "phone") for ms in (5, 3, 7)]
    schema = "id long, vault_id long, file_path string, action string, changed_at_unix_ms long, content_base64 string, content_sha256 string, size_bytes long, device_id string"
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        log = spark.createDataFrame(given, schema)
        assert tuple(changelog.latest_change(log, "vault_id").first()) == (1, 9, 3)
        got = changelog.current_state(log).first()
        assert (got["updated_unix_ms"], got["content_sha256"], got["content_version"]) == (3, "s3", 3)


def test_pushed_jobs_where_change_ids_recur(spark, tmp_path):
    """As the SQL counts them: a change once for each event of its id."""
    import duckdb

    from marginalia.plans import catalogue

    at = str(tmp_path / "events.parquet")
    duckdb.sql(f"copy (select event_id + k * 1000003 as event_id, ts, user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet', range(2) r(k)) to '{at}'")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}'")
    want = sorted(con.execute(f"select vault_id, file_path, file_version, job_type, status from ({catalogue.ORACLES['push_applied_jobs']})").fetchall())
    got = catalogue.QUERIES["push_applied_jobs"](spark, str(tmp_path)).select("vault_id", "file_path", "file_version", "job_type", "status").collect()
    assert sorted(map(tuple, got)) == want


def test_folders_are_listed_in_parts_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """A bounded number of names at a time, below several levels; what is read doesn't pass through a listing by the driver."""
    from pyarrow import fs as pa_fs

    for k in range(25):
        at = tmp_path / f"d{k % 2}" / "deep"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k}.md").write_bytes(b"x" * k)
    monkeypatch.setattr(directory, "NAMES", 10)
    parts = list(directory._batches(pa_fs.LocalFileSystem(), str(tmp_path), True))
    assert [len(p) for p in parts] == [10, 10, 5]
    got = directory.read_folder(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["size_bytes"], bytes(r["content"])) for r in got) == sorted((f"d{k % 2}/deep/{k}.md", k, b"x" * k) for k in range(25))
    assert directory.read_folder(spark, str(tmp_path)).inputFiles() == []
