import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from marginalia.llm import lexical_search
from marginalia.llm.lexical_search import Postings, best_documents, packed, ranked_search, terms_of, unpacked
from marginalia.llm.queries import op12_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    rows = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        found = []
        for i, c, size in rows:
            m = 100 - 90 + 90 * size * n // total
            score = sum(x * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in w.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment", [1 << 24, 40_000])
def test_whole_table(spark, monkeypatch, segment):
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    docs, items = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(list(zip(docs.doc_id, docs.text)), list(zip(items.item_id, items.text)))
    assert got(op12_ranked_search(spark, "/root/testdata/sf0.01")) == want


def test_odd_rows(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 2)
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    rows = odd_rows + [(i, f"Same words HERE and {i % 3}", "en") for i in range(30, 60)]
    items = [(1, "same WORDS, here!"), (2, None), (3, ""), (4, "no-such-term_at zzz"), (5, "日本語 😀 drei"), (1, "today"), (None, "lead word5 id"), (6, "... ,"), (7, "a a a b")]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, q long, block long, term long")
    assert got(ranked_search(make_docs(rows), table)) == brute([r[:2] for r in rows], items)
    assert ranked_search(make_docs([]), table).count() == 0 and ranked_search(make_docs(rows), table.limit(0)).count() == 0


def test_many_copies_and_a_word_of_all_texts(spark, make_docs, monkeypatch):
    """Ties across segments go to smaller ids; a word in every text has its postings in every segment."""
    monkeypatch.setattr(lexical_search, "SEGMENT", 3000)
    rng = random.Random(3)
    rows = [(i, "every one of these copies is the same" if i % 3 == 0 else "every " + " ".join(f"w{rng.randrange(40)}" for _ in range(12)), "en") for i in range(900)]
    rng.shuffle(rows)
    items = [(1, "these copies every"), (2, "w1 w2 w3"), (3, "every")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked_search(make_docs(rows).repartition(5), table)) == brute([r[:2] for r in rows], items)


def test_blocks_below_the_threshold_stay_compressed():
    """Of a frequent term's blocks only those that the rare term's good documents need are opened."""
    docs, norms = 100_000, np.full(100_000, 100, dtype=np.int64)

    def postings(numbers, tf, weight):
        starts = range(0, len(numbers), lexical_search.BLOCK)
        cut = [(numbers[s : s + lexical_search.BLOCK], tf[s : s + lexical_search.BLOCK]) for s in starts]
        data = [packed(np.stack([np.diff(d, prepend=0), f - 1], axis=1).ravel())[0] for d, f in cut]
        tops = [int((10**9 * f // (1000 * f + 800)).max()) for _, f in cut]
        return Postings(weight, len(numbers), [d[-1] for d, _ in cut], tops, np.cumsum([len(x) for x in data]), np.concatenate(data).tobytes(), norms)

    rng = np.random.default_rng(5)
    common = postings(np.arange(docs), np.ones(docs, dtype=np.int64), 100)
    rare_docs = np.sort(rng.choice(docs, 600, replace=False))
    rare = postings(rare_docs, np.where(np.arange(600) // 128 == 2, 50, 1), 5000)
    top, scores = best_documents([common, rare], docs, 10)
    want = np.zeros(docs, dtype=np.int64)
    want += 100 * (10**9 // 1800)
    want[rare_docs] += 5000 * (10**9 * np.where(np.arange(600) // 128 == 2, 50, 1) // (1000 * np.where(np.arange(600) // 128 == 2, 50, 1) + 800))
    order = np.lexsort((np.arange(docs), -want))[:10]
    assert (top == order).all() and (scores == want[order]).all()
    assert common.open.mean() < 0.3 and rare.open.sum() <= 2


def test_packed_bytes():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in range(1, 50)] + [[0, 127, 128, 16383, 16384]]).astype(np.int64)
    data, ends = packed(values)
    assert (unpacked(data) == values).all() and ends[-1] == len(data)
    assert len(unpacked(packed(np.zeros(0, dtype=np.int64))[0])) == 0


def test_terms():
    for t in ("A-b_c d9é É\x85x\xa0y", "", None, "日本 語.", "__ !!", "ÄÖ\x7f{z}"):
        assert [w.decode() for w in terms_of(t)] == words(t)
