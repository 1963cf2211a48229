import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from marginalia.llm import lm_scoring as lm
from marginalia.llm.queries import op8_lm_scoring

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ")
    for c in "\t\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</s>"]


def brute(rows, weights=None):
    fold = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7
    taught = [tokens(t) for i, t in rows if fold(i) != 2]
    one = Counter(w for d in taught for w in d)
    two = Counter(p for d in taught for p in zip([None, *d], d))
    total, kinds = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        d = tokens(t)
        base = sum(math.log10((one[w] + 1) / (total + kinds + 1)) for w in d)
        score = 0.0
        for a, w in zip([None, *d], d):
            h = len(taught) if a is None else one[a]
            if weights is not None:
                x = weights[lm._bucket(np.array([float(h)]))[0]]
                score += math.log10(x[0] * two[a, w] / max(1, h) + x[1] * one[w] / max(1, total) + x[2] / (kinds + 1))
        out.append((-1 if i is None else i, fold(i) == 2, len(d), sum(one[w] > 0 for w in d), total, base, score))
    return sorted(out)


def same(df, want):
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want]) and np.allclose([g[6] for g in got], [w[6] for w in want])
    return got


@pytest.fixture
def learned(monkeypatch):
    """The weights that a run learns."""
    seen, real = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells, counts: seen.append(real(cells, counts)) or seen[-1])
    return seen


def test_whole_table(spark, learned):
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]]
    df = op8_lm_scoring(spark, SF)
    got = same(df, brute([(int(i), t) for i, t in docs.itertuples(index=False)], learned[0]))
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the base on held-out texts


def test_odd_rows(make_docs, odd_rows, learned):
    df = lm.lm_scores(make_docs(odd_rows))
    same(df, brute([r[:2] for r in odd_rows], learned[0]))


def test_empty_and_untaught(make_docs):
    assert lm.lm_scores(make_docs([])).count() == 0
    only_held_out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = lm.lm_scores(make_docs([(i, "a b", "en") for i in only_held_out])).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in rows] == [(0, 0, 0.0)] * 3


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, for a seen context."""
    taught = [tokens("a b a c"), tokens("a b b")]
    one, two = Counter(w for d in taught for w in d), Counter(p for d in taught for p in zip([None, *d], d))
    mix, total, kinds = np.array([0.5, 0.3, 0.2]), sum(one.values()), len(one)
    p = [mix[0] * two["a", w] / one["a"] + mix[1] * one[w] / total + mix[2] / (kinds + 1) for w in [*one, "?"]]
    assert abs(sum(p) - 1) < 1e-12


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    true, level = np.array([0.6, 0.3, 0.1]), lambda ratio: int(round(math.log(ratio) * lm.STEP)) + lm.ZERO_AT
    # Three kinds of tokens, each likely under one part: their shares show the weights.
    ratios = np.array([[math.exp(10), 0], [0, math.exp(10)], [0, 0]])
    counts = Counter(rng.choice(3, p=true, size=20_000).tolist())
    cells = [(5 * lm.LEVELS + (level(a) if a else 0)) * lm.LEVELS + (level(b) if b else 0) for a, b in ratios]
    order = np.argsort(cells)
    w = lm.learn_weights(np.array(cells)[order], np.array([counts[k] for k in order], dtype=float))
    assert np.allclose(w[5], true, atol=0.02)


def test_sums_beyond_32_bits():
    import pyarrow as pa

    keys = np.array([5, 9], dtype=np.uint64)
    blob = lambda x, k: lm._pack(np.array(x, dtype=k))
    asked = pa.table({
        "ord": pa.array([1, 1, 1], pa.int32()), "part": pa.array([0, 0, 0], pa.int32()), "batch": ["x", "y", "z"], "a": [lm._pack(np.diff(keys, prepend=np.uint64(0)))] * 3,
        "b": [blob([3_000_000_000, 1], "<u4")] * 3, "c": [blob([0, 1], "<u4")] * 3})
    rows = lm._answer(asked).to_pylist()
    assert all(lm._unpack(r["seen"], "<i8").tolist() == [9_000_000_000, 3] for r in rows[:3])
    assert (rows[-1]["n_kinds"], rows[-1]["n_seen"], rows[-1]["n_dev"]) == (2, 9_000_000_003, 3)
