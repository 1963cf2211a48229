import zlib

import numpy as np
import pytest

from marginalia.llm import token_files
from marginalia.llm.bpe import worker_bpe
from marginalia.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def library():
    bpe = worker_bpe()
    return lambda t: bpe.library.encode(t or "", add_special_tokens=False).ids


def test_counts(make_docs, odd_rows, library):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(make_docs(odd_rows)).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(library(t)), len(library(t)) > 512) for i, t, _ in odd_rows)


def test_classes_of_characters_agree(library):
    """The texts that are split at spaces come out as the library has them, for every kind of character."""
    import pyarrow as pa

    bpe = worker_bpe()
    points = [*range(1, 0x530), *range(0x2010, 0x2028), *range(0x3041, 0x3097), *range(0x4E00, 0x9FA6, 97), *range(0xAC00, 0xD7A4, 97), 0x558, 0x1F600, 0xA0, 0x85, 0x2028]
    texts = [f"a{chr(p)}b {chr(p)} 1{chr(p)}! {chr(p)}{chr(p)} x\n{chr(p)}" for p in points]
    ids, lengths = bpe.ids(pa.array(texts))
    cuts = np.append(0, np.cumsum(lengths))
    assert all(ids[a:b].tolist() == library(t) for t, a, b in zip(texts, cuts, cuts[1:]))


def test_files_round_trip(make_docs, odd_rows, library):
    rows = token_files.token_file_round_trip(make_docs(odd_rows)).collect()
    want, start = [], 0
    texts = {}
    for i, t, _ in odd_rows:
        texts.setdefault(i, []).append([*library(t), 2])
    assert len(rows) == len(odd_rows)
    by_start = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in by_start] == sorted(i or -1 for i, _, _ in odd_rows)
    for r in by_start:
        assert r["start"] == start
        start += r["n_tokens"]
        want = [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in texts[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_crc32"]) in want


def test_empty_table(make_docs):
    assert token_files.token_file_round_trip(make_docs([])).count() == 0 and token_counts(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 50_000, rng.integers(1, 9)) for _ in range(50)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 50, 3000 * (seed + 1))] + [np.zeros(37, dtype=int)] * 3)
    rules, spans, body = token_files.compress(ids)
    assert (token_files.expand(rules, spans, body) == ids).all() and len(body) < len(ids) / 2
    for start, n in ((0, 1), (5, 100), (len(ids) - 9, 9), (777, 0), (0, len(ids))):
        assert (token_files.decode_range(rules, spans, body, start, n) == ids[start : start + n]).all()


def test_documents_are_read_alone(spark, make_docs, odd_rows, library, monkeypatch, tmp_path):
    """Ranges are decoded without the rules that they don't reach."""
    path = f"{tmp_path}/files"
    token_files.write_token_files(make_docs(odd_rows), path)
    got = {}
    for r in token_files.read_documents(spark, path, [4, 6, 9, 777]).collect():
        got.setdefault(r["doc_id"], []).append(r["ids"])
    texts = {i: [[*library(t), 2] for j, t, _ in odd_rows if j == i] for i in (4, 6, 9)}
    assert got == texts
    assert token_files.read_documents(spark, path, []).count() == 0
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 30), 20), np.tile(rng.integers(100, 150, 30), 20)])
    rules, spans, body = token_files.compress(ids)
    broken = rules.copy()
    late = (rules >= 100).all(axis=1) & (rules < 150).all(axis=1)
    broken[late] = -1  # rules of the second half
    assert late.any() and (token_files.decode_range(broken, spans, body, 10, 400) == ids[10:410]).all()


def test_tiny_grammars():
    for ids in ([], [5], [5, 5], [5] * 101):
        rules, spans, body = token_files.compress(np.array(ids, dtype=int))
        assert token_files.expand(rules, spans, body).tolist() == ids


@pytest.mark.parametrize("seed", range(3))
def test_grammars_go_on_until_no_pair_is_frequent(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([(rng.zipf(1.3, 60_000) % 5000), np.tile([1, 2, 3, 4, 5], 300), np.zeros(99, dtype=int)])
    rules, spans, body = token_files.compress(ids)
    assert (token_files.expand(rules, spans, body) == ids).all()
    seen, at = {}, 0
    while at < len(body) - 1:  # pairs from left to right, those that overlap themselves once
        pair = (int(body[at]), int(body[at + 1]))
        seen.setdefault(pair, []).append(at)
        at += 1
    apart = lambda places: 1 + sum(b - a > 1 for a, b in zip(places, places[1:]))  # noqa: E731  runs of one symbol
    assert all(len(v) < token_files.LEAST or (p[0] == p[1] and apart(v) < token_files.LEAST) for p, v in seen.items())
    used = set(body.tolist()) | set(rules.ravel().tolist())
    assert len(rules) and all(token_files.FIRST_RULE + r in used for r in range(len(rules)))
    assert spans.tolist() == [len(token_files.expand(rules, spans, np.array([token_files.FIRST_RULE + r]))) for r in range(len(rules))]


def test_whole_table_against_the_library(spark):
    """Every text of sf0.01 in one call of the library, for the counts and the files."""
    from marginalia.llm.queries import op3_token_counts, op9_token_id_output

    d = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    ids = [e.ids for e in worker_bpe().library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op3_token_counts(spark, d).collect()}
    assert counts == {i: (len(t.encode()), len(x), len(x) > 512) for (i, t), x in zip(rows, ids)}
    want, start = {}, 0
    for (i, _), x in zip(rows, ids):
        want[i] = (start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        start += len(x) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op9_token_id_output(spark, d).collect()} == want
