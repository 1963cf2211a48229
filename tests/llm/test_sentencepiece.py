import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm.sentencepiece_sampling import decode_ids, sampled_encodings, worker_pieces
from marginalia.llm.piece_lattice import MARK


@pytest.fixture(scope="module")
def pieces():
    return worker_pieces()


def paths(pieces, word):
    """All segmentations of a word into pieces, with their log weights."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    full = MARK + word.replace(" ", MARK)

    def cut(at):
        if at == len(full):
            yield (), 0.0
        for end in range(at + 1, len(full) + 1):
            if (i := known.get(full[at:end])) is not None:
                for rest, weight in cut(end):
                    yield (i, *rest), weight + float(pieces.weights[i])

    found = list(cut(0))
    total = math.log(sum(math.exp(w) for _, w in found))
    return {p: w - total for p, w in found}


def ids_of(row):
    return tuple(row["ids"])


def test_round_trip_of_odd_rows(make_docs, odd_rows):
    rows = decode_ids(sampled_encodings(make_docs(odd_rows), k=3)).collect()
    texts = Counter((i, (t or "").encode()) for i, t, _ in odd_rows)
    first = Counter((r["doc_id"], r["decoded"].encode()) for r in rows if r["sample"] == 1)
    assert first == texts
    assert {(r["doc_id"], r["decoded"].encode()) for r in rows} == set(texts)
    by = defaultdict(list)
    for r in rows:
        assert r["decoded_crc32"] == zlib.crc32(r["decoded"].encode()) and r["n_bytes"] == len(r["decoded"].encode())
        assert r["n_pieces"] == len(ids_of(r)) and 0 <= r["inclusion"] <= 1 and r["log_prob"] <= 1e-9
        assert np.isfinite(r["log_inclusion"]) and abs(math.exp(r["log_inclusion"]) - r["inclusion"]) < 1e-12
        by[r["doc_id"], r["decoded"]].append(r)
    for found in by.values():
        one = {}
        for r in found:  # repeated rows give the same samples
            assert one.setdefault(r["sample"], ids_of(r)) == ids_of(r)
        assert len(set(one.values())) == len(one)
        values = [r["perturbed"] for r in sorted(found, key=lambda r: r["sample"])]
        assert all(a >= b for a, b in zip(values, values[1:]))


def test_probabilities_and_frequencies(make_docs, pieces):
    want = paths(pieces, "the")
    n = 4000
    rows = sampled_encodings(make_docs([(i, "the", "en") for i in range(n)]), k=2).collect()
    first, both = Counter(), Counter()
    for r in rows:
        assert abs(r["log_prob"] - want[ids_of(r)]) < 1e-9
        both[ids_of(r)] += 1
        first[ids_of(r)] += r["sample"] == 1
    # The first is a draw from the model; two together are a draw without replacement.
    for p, log_p in want.items():
        chance = math.exp(log_p)
        assert abs(first[p] / n - chance) < 4 * math.sqrt(chance * (1 - chance) / n) + 1e-3
        pair = chance + sum(math.exp(q) * chance / (1 - math.exp(q)) for other, q in want.items() if other != p)
        assert abs(both[p] / n - pair) < 4 * math.sqrt(max(pair * (1 - pair), 0) / n) + 1e-3


def test_inclusion_scores_estimate_sums(make_docs, pieces):
    """Probabilities over inclusion scores of the emitted paths sum to one on average."""
    rows = sampled_encodings(make_docs([(i, "the end", "en") for i in range(3000)]), k=3).collect()
    by = defaultdict(float)
    for r in rows:
        by[r["doc_id"]] += math.exp(r["log_prob"]) / r["inclusion"]
    assert abs(np.mean(list(by.values())) - 1) < 0.03


def test_all_paths_of_a_short_text(make_docs, pieces):
    want = paths(pieces, "the")
    rows = sampled_encodings(make_docs([(i, "the", "en") for i in range(30)]), k=len(want) + 3).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert all({ids_of(r) for r in found} == set(want) and len(found) == len(want) for found in by.values())
    assert all(r["inclusion"] == 1 for r in rows)


def test_runs_of_spaces_and_long_words_have_all_their_paths(make_docs, pieces):
    """Pieces that are runs of spaces take part, and no piece is lost at a cut of a long word."""
    for text in ("a   b", "  a", "a  "):
        want = paths(pieces, text)
        rows = sampled_encodings(make_docs([(1, text, "en")]), k=len(want) + 2).collect()
        assert {ids_of(r) for r in rows} == set(want)
        assert all(abs(r["log_prob"] - want[ids_of(r)]) < 1e-9 for r in rows)


def forward_sum(pieces, text):
    """The log of the sum over all segmentations of a text, from its beginning on."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    full = MARK + text.replace(" ", MARK)
    mass = [0.0] + [-math.inf] * len(full)
    for end in range(1, len(full) + 1):
        for at in range(max(0, end - 16), end):
            i = known.get(full[at:end])
            weight = float(pieces.weights[i]) if i is not None else float(pieces.fallback) if end - at == 1 else -math.inf
            mass[end] = float(np.logaddexp(mass[end], mass[at] + weight))
    return known, mass[-1]


def test_probabilities_of_a_long_word(make_docs, pieces):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("etaoinshr"), 600)) + "    x日本語 end"
    known, total = forward_sum(pieces, text)
    for r in sampled_encodings(make_docs([(1, text, "en")]), k=2).collect():
        weight = sum(float(pieces.weights[i]) for i in ids_of(r) if i not in set(pieces.byte_ids.tolist()))
        odd = sum(c not in known for c in text.replace(" ", MARK))  # characters given as bytes
        assert abs(weight + odd * pieces.fallback - total - r["log_prob"]) < 1e-6


def test_the_mark_of_spaces_decodes_to_a_space(make_docs):
    rows = decode_ids(sampled_encodings(make_docs([(1, "a▁b c▁", "en")]))).collect()
    assert {r["decoded"] for r in rows} == {"a b c "}


def test_decode_null_and_empty_ids(spark):
    rows = decode_ids(spark.createDataFrame([(1, None, 7), (2, [], 8)], "i long, ids array<int>, decoded int")).collect()
    assert {(r["i"], r["decoded"]) for r in rows} == {(1, None), (2, "")}


def test_every_row_has_two_samples(make_docs, odd_rows):
    assert sampled_encodings(make_docs([])).count() == 0
    rows = sampled_encodings(make_docs(odd_rows)).collect()
    assert {r["sample"] for r in rows} == {1, 2}
    for i, t, _ in odd_rows:
        assert any(r["doc_id"] == i and r["n_bytes"] == len((t or "").encode()) for r in rows)
