import zlib
from collections import Counter, defaultdict

from marginalia.llm.sharding import balanced_label_propagation


def check(rows, n, shards):
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_odd_rows(make_docs, odd_rows):
    rows = balanced_label_propagation(make_docs(odd_rows)).collect()
    check(rows, len(odd_rows), 24)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_empty_table(make_docs):
    assert balanced_label_propagation(make_docs([])).count() == 0


def test_groups_stay_together_and_hot_ones_are_split(make_docs):
    rows = [(i, f"unique {i}", "en") for i in range(300)]
    rows += [(1000 + i, "hot copy", "en") for i in range(200)]
    rows += [(2000 + i, f"pair {i // 2}", "en") for i in range(100)]
    got = balanced_label_propagation(make_docs(rows), shards=6).collect()
    check(got, 600, 6)
    at = defaultdict(list)
    for r in got:
        at[r["text_crc32"]].append(r["shard"])
    hot = Counter(at[zlib.crc32(b"hot copy")])
    assert len(hot) <= 4 and max(hot.values()) > 50  # of six shards of 100 rows, whose quotas the pairs share
    apart = sum(len(set(s)) > 1 for k, s in at.items() if len(s) == 2)
    assert apart <= 5


def test_results_repeat(make_docs):
    docs = make_docs([(i, f"t{i % 40}", "en") for i in range(100)])
    assert {tuple(r) for r in balanced_label_propagation(docs).collect()} == {tuple(r) for r in balanced_label_propagation(docs).collect()}


def test_fewer_copies_lie_apart_than_by_hash(make_docs):
    rows = [(i, f"group {i // 5}" if i < 400 else f"alone {i}", "en") for i in range(900)]
    got = balanced_label_propagation(make_docs(rows), shards=8).collect()
    check(got, 900, 8)
    shard = {r["doc_id"]: r["shard"] for r in got}
    start = {r["doc_id"]: r["shard"] for r in balanced_label_propagation(make_docs(rows), shards=8, rounds=0).collect()}
    pairs = [(a, b) for a in range(400) for b in range(a + 1, min(400, a // 5 * 5 + 5))]
    cut, before = (sum(at[a] != at[b] for a, b in pairs) for at in (shard, start))
    assert before > 600 and cut <= 80  # of 800 links; only what full shards force apart


def test_propagation_settles(make_docs):
    docs = make_docs([(i, f"t{i % 40}", "en") for i in range(200)])
    settled = balanced_label_propagation(docs, shards=5)
    longer = balanced_label_propagation(docs, shards=5, rounds=200)
    assert {tuple(r) for r in settled.collect()} == {tuple(r) for r in longer.collect()}
