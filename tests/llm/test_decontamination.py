import hashlib
import re

import pandas as pd

from marginalia.llm import decontamination as d
from marginalia.llm.queries import op6_benchmark_decontamination

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name))
    sizes, out = sorted({len(w) for w in windows}), []
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= found
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((-1 if i is None else i, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out)


def told(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_whole_table(spark):
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(docs[["doc_id", "text"]].itertuples(index=False), items[["item_id", "text"]].itertuples(index=False))
    assert told(op6_benchmark_decontamination(spark, SF)) == want and any(w[-1] for w in want)


ITEMS = [(1, "Alpha beta"), (2, "a b c d e f g h i j k l"), (3, None), (4, "..."), (5, "alpha BETA"), (10, "b c d e f g h i j k"), (6, "same text here")]


def test_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (50, "ALPHA, beta alpha-beta x", "en"), (51, "z a b c d e f g h i j k l z", "en"), (52, "alpha", "en"), (53, "beta", "en")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert told(d.decontamination_report(make_docs(rows), items)) == brute([r[:2] for r in rows], ITEMS)


def test_several_rounds_agree(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(d, "ROUND_WORDS", 2)
    rows = [*odd_rows, (50, "ALPHA, beta alpha-beta x", "en"), (51, "z a b c d e f g h i j k l z", "en")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert told(d.decontamination_report(make_docs(rows), items)) == brute([r[:2] for r in rows], ITEMS)


def test_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert told(d.decontamination_report(make_docs(odd_rows), none)) == brute([r[:2] for r in odd_rows], [])
    assert d.decontamination_report(make_docs([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_filter(spark, make_docs, odd_rows):
    docs = make_docs([*odd_rows, (50, "x alpha beta", "en")])
    kept = d.keep_uncontaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i, t, _ in odd_rows if "same text here" not in (t or ""))


def test_proximity(make_docs, odd_rows):
    """Sets of terms within a span, against a look at every window of every document."""
    import random

    rng = random.Random(11)
    rows = [*odd_rows, *((100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))), "en") for i in range(40))]
    sets, spans = [["a", "b"], ["A", "c", "d"], ["text", "here"], ["a"], [], ["a", "nowhere"], ["b", "b", "h"], ["...", "g e"]], (1, 3, 5, 64)
    index = d.build_index(make_docs(rows))
    for span in spans:
        want = []
        for i, text, _ in rows:
            w = split(text)
            for q, terms in enumerate(sets):
                terms = {x for t in terms for x in split(t)}
                for k in range(len(w)):
                    window = w[k : k + span]
                    if terms and w[k] in terms and terms <= set(window):
                        want.append((i or -1, q, k, k + 1 + max(window.index(t) for t in terms)))
        got = sorted((r["doc_id"] or -1, r["query"], r["start"], r["stop"]) for r in d.proximity_matches(index, sets, span).collect())
        assert got == sorted(want)
    assert want


def test_rows_in_blocks_of_one_shape(spark, make_docs, monkeypatch):
    """Null ids and repeated rows in blocks that look alike each come back, also after several rounds."""
    monkeypatch.setattr(d, "BLOCK_BYTES", 1)
    monkeypatch.setattr(d, "ROUND_WORDS", 2)
    rows = [(None, "alpha beta", "en"), (None, "gamma delta", "en"), (7, "alpha beta", "en"), (7, "alpha beta", "en")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert told(d.decontamination_report(make_docs(rows), items)) == brute([r[:2] for r in rows], ITEMS)
