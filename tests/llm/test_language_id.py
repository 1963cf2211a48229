import zlib

import pandas as pd

from marginalia.llm.language_id import has_letter, keep_known_languages, language_report
from marginalia.llm.queries import op5_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    got = op5_language_id(spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got["held_out"].items())
    assert got["score"].between(0, 1).all() and set(got["lang_pred"]) <= {"und", *docs["lang"].dropna()}
    real = docs.join(got, rsuffix="_got")
    real = real[real["held_out"] & real["lang"].notna() & real["text"].map(has_letter)]
    assert len(real) > 100 and (real["lang"] == real["lang_pred"]).mean() >= 0.95


def test_odd_rows(make_docs, odd_rows):
    got = language_report(make_docs(odd_rows)).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(i or -1 for i, _, _ in odd_rows)
    und = sorted(r["doc_id"] or -1 for r in got if r["lang_pred"] == "und")
    assert und == sorted(i or -1 for i, t, _ in odd_rows if not has_letter(t))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from(make_docs):
    assert language_report(make_docs([])).count() == 0
    rows = language_report(make_docs([(i, "some words", None) for i in range(9)])).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    real = {r["doc_id"] for r in docs.filter("lang is not null").collect() if r["text"] and len(r["text"].split()) > 20}
    assert len(real & ids) >= 0.98 * len(real)


def slow_grams(text):
    """Distinct n-grams of one to three folded symbols."""
    fold = lambda b: b - 96 if 97 <= b <= 122 else 27 + (b & 31) if b >= 128 else 0
    s = [fold(b) for b in text.lower().encode()]
    return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_scores_against_kernel_ridge_on_all_rows(make_docs):
    """With every training row a landmark the approximation is exact: scores are those of the full kernel matrix."""
    import random

    import numpy as np

    from marginalia.llm.language_id import RIDGE

    rng = random.Random(2)
    stems = {"aa": ["ba", "no", "ti", "Re"], "bb": ["zü", "ko", "wy", "xe"], "cc": ["la", "ñi", "so", "no"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(rng.randrange(4, 30))), lang) for i in range(90) for lang in [sorted(stems)[i % 3]]]
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in language_report(make_docs(rows)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    train = [r for r in rows if not held[r[0]]]
    assert len({t for _, t, _ in train}) == len(train) and max(sum(r[2] == x for r in train) for x in stems) <= 160 // 3
    grams = {i: slow_grams(t) for i, t, _ in rows}
    kernel = lambda a, b: len(grams[a] & grams[b]) / np.sqrt(len(grams[a]) * len(grams[b]))
    names = sorted(stems)
    k = np.array([[kernel(a[0], b[0]) for b in train] for a in train])
    y = np.array([[float(r[2] == x) for x in names] for r in train])

    def off(parts):
        """The largest difference, if the sums of so many parts carry a ridge each (Spark packs the sample's twelve files into one or more)."""
        w = np.linalg.solve(k + parts * RIDGE * np.eye(len(train)), y)
        f = np.array([[kernel(i, b[0]) for b in train] for i, *_ in rows]) @ w
        assert [got[i][:2] for i, *_ in rows] == [(held[i], names[int(x.argmax())]) for (i, *_), x in zip(rows, f)]
        return max(abs(got[i][2] - min(1, max(0, x.max()))) for (i, *_), x in zip(rows, f))

    assert min(off(parts) for parts in range(1, 13)) < 1e-4
