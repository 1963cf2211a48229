import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup
from marginalia.llm.exact_dedup import exact_duplicates, without_copies
from marginalia.llm.queries import op13_exact_dedup


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, pick):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        out += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=repr)


def test_whole_table(spark):
    for sf in ("0.001", "0.01"):
        docs = pd.read_parquet(f"/root/testdata/sf{sf}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in docs.itertuples()]
        assert got(op13_exact_dedup(spark, f"/root/testdata/sf{sf}")) == brute(rows, max)


def test_odd_rows(spark, make_docs, odd_rows):
    rows = odd_rows + [(20, "ABC Éé", "en"), (21, "abc Éé", "en"), (22, "abc éé", "en"), (23, "ABC", "en"), (24, "abc", "en"), (25, "abc ", "en"), (26, "İ", "en")]
    docs = make_docs(rows)
    for keep, pick in (("smallest", min), ("largest", max)):
        assert got(exact_duplicates(docs, keep=keep)) == brute([r[:2] for r in rows], pick)
    left = without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(fold(r["text"]) for r in left.collect()) == sorted({fold(t) for _, t, _ in rows})
    assert exact_duplicates(make_docs([])).count() == 0 and without_copies(make_docs([])).count() == 0


def test_colliding_hashes_are_told_apart_by_bytes(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, f"text {rng.randrange(60)}", "en") for i in range(300)]
    same = lambda text: [F.length(text).cast("long") * 0, F.length(text).cast("long") * 0]
    assert got(exact_duplicates(make_docs(rows), keep="largest", hashes=same)) == brute([r[:2] for r in rows], max)


def test_hot_groups_come_by_broadcast(spark, make_docs, monkeypatch):
    """A third of all rows in one group; no shuffled key holds over one in HOT of the rows."""
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    rows = [(i, "Hot" if i % 3 else f"cold {i // 7}", "en") for i in range(3000)]
    df = exact_duplicates(make_docs(rows), keep="largest")
    assert got(df) == brute([r[:2] for r in rows], max)
    assert "BroadcastHashJoin" in df._jdf.queryExecution().toString()


def test_native(spark, make_docs):
    plan = exact_duplicates(make_docs([(1, "a", "en")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
