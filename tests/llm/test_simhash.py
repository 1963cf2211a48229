import random
from collections import Counter

import pytest
import xxhash

from marginalia.llm import simhash
from marginalia.llm.components import connected_components


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_print(t) for _, t, _ in rows]
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, f"{prints[a]:016x}", least.get(find(a))) for a, (i, _, _) in enumerate(rows))


def test_odd_rows(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6] + [(6, "short A B c", "en")]
    got = Counter(tuple(r) for r in simhash.simhash_report(make_docs(rows)).collect())
    assert got == slow_components(rows)


def test_long_text_and_shingle_counts(prose):
    for n in (1, 2, 3, 4, 500):
        assert simhash.fingerprint(prose(n, n)) & (1 << 64) - 1 == slow_print(prose(n, n))


@pytest.mark.parametrize("tile", [8, 1024])
def test_against_brute_force(make_docs, prose, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(1)
    rows = []
    for i in range(150):
        words = prose(i % 30, 120).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en"))
    got = Counter(tuple(r) for r in simhash.simhash_report(make_docs(rows)).collect())
    assert got == slow_components(rows)


def test_links_of_fingerprints(spark, monkeypatch):
    """All links among crowded fingerprints, with tiles of several kinds."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(25)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    forest = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r["node"]: r["root"] for r in connected_components(forest).collect()}
    group = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for a, x in zip(signed, prints):
            for b, y in zip(signed, prints):
                if (x ^ y).bit_count() <= 3 and group[b] < group[a]:
                    group[a], changed = group[b], True
    assert {p: got.get(p, p) for p in signed} == group


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_one_of_each_group_stays(make_docs, odd_rows, prose):
    rows = odd_rows + [(50 + i, prose(9, 80), "en") for i in range(5)]
    docs = make_docs(rows)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 50 in ids and not {51, 52, 53, 54} & set(ids) and ids.count(4) == 1 and 5 not in ids and 1 in ids and 2 not in ids


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_against_brute_force_similarity(make_docs, prose):
    """Pairs of a known five-word similarity: those from 0.8 on are found, none below it."""
    rng = random.Random(3)
    rows, pairs = [], []
    for k in range(300):
        words = prose(1000 + k, 60 + 3 * k % 300, words=3000).split()
        other = list(words)
        for _ in range(rng.randrange(0, 1 + len(words) // 14)):
            other[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(other), "en")]
        pairs.append((2 * k + 1, jaccard(rows[-2][1], rows[-1][1])))
    kept = {r["doc_id"] for r in simhash.keep_one_each(make_docs(rows)).collect()}
    assert {2 * k for k in range(300)} <= kept
    near, far = [i for i, j in pairs if j >= 0.8], [i for i, j in pairs if j < 0.8]
    assert len(near) > 60 and sum(i not in kept for i in near) >= 0.98 * len(near)
    assert len(far) > 30 and all(i in kept for i in far)


def test_short_and_repetitive_texts(make_docs):
    """Texts of a few shingles at similarity 0.8; texts that share only a phrase repeated many times."""
    short = [(10 * k, " ".join(f"s{k}x{i}" for i in range(8)), "en") for k in range(40)]
    longer = [(i + 1, t + " more", "en") for i, t, _ in short]  # 4 of 5 shingles
    other = [(i + 2, "y " + t + " more then", "en") for i, t, _ in short]  # 5 of 7
    spam = [(1000 + k, "ha " * 200 + " ".join(f"z{k}x{i}" for i in range(20)), "en") for k in range(20)]
    kept = {r["doc_id"] for r in simhash.keep_one_each(make_docs(short + longer + spam)).collect()}
    assert {i for i, _, _ in short + spam} <= kept and len(kept & {i for i, _, _ in longer}) <= 1
    assert {i for i, _, _ in short + other} == {r["doc_id"] for r in simhash.keep_one_each(make_docs(short + other)).collect()}


def test_forest_of_sure_and_open_links():
    import numpy as np

    i, j, d = (np.array(x) for x in ([0, 1, 2, 3, 0, 2], [1, 2, 3, 4, 4, 4], [1, 9, 1, 7, 8, 7]))
    node, other, bits, dead = simhash._forest(6, i, j, d, 5)
    assert not dead.any()
    got = {(int(a), int(b), int(c)) for a, b, c in zip(node, other, bits)}
    assert {g for g in got if g[2] == 0} == {(1, 0, 0), (3, 2, 0)}
    assert {g[2] for g in got if g[2]} == {7, 8} and len(got) == 4  # nearest first, one fewer than nodes joined


def test_a_large_group_of_near_copies(make_docs, prose, monkeypatch):
    """More copies under one anchor than a tile holds."""
    monkeypatch.setattr(simhash, "TILE", 16)
    base = prose(77, 200, words=3000).split()
    rows = [(i, " ".join([*base[:100], f"n{i}", *base[100:]]), "en") for i in range(150)]
    rows += [(1000 + i, prose(2000 + i, 80, words=3000), "en") for i in range(20)]
    kept = {r["doc_id"] for r in simhash.keep_one_each(make_docs(rows)).collect()}
    assert kept == {0, *range(1000, 1020)}


def test_empty_table(make_docs):
    assert simhash.simhash_report(make_docs([])).count() == 0 and simhash.keep_one_each(make_docs([])).count() == 0


@pytest.mark.parametrize(("tile", "fan", "growth", "sketch"), [(1024, 8, 8, 256), (16, 1, 2, 256), (1024, 8, 8, 16), (16, 1, 2, 16)])
def test_a_failed_check_loses_no_other_link(spark, prose, monkeypatch, tile, fan, growth, sketch):
    """Links that nearer, but failing, texts stood for are found in later rounds."""
    import numpy as np

    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "FAN", fan)
    monkeypatch.setattr(simhash, "GROWTH", growth)
    rng = np.random.default_rng(4)
    texts = []
    for g in range(9):
        words = prose(500 + g, 90, words=3000).split()
        for i in range(5):  # a chain: each text is similar to the next one
            words[17 * i + 3] = f"new{g}x{i}"
            texts.append(" ".join(words))
    rows = []
    for i, text in enumerate(texts):  # fingerprints of no use: all are at 81 to 240 bits, in an order of their own
        raw = np.zeros(1024, dtype=np.uint8)
        raw[rng.choice(1024, rng.integers(55, 110), replace=False)] = 1
        bits = np.packbits(raw, bitorder="little").view("<i8").tolist()
        rows.append((int(rng.integers(-(1 << 60), 1 << 60)), i, 7 * i, bits, [5, 5, 6]))
    names = [r[0] for r in rows]
    root = list(names)
    for _ in range(6):
        for a in range(len(rows)):
            for b in range(a):
                if jaccard(texts[a], texts[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(set(root)) == 9
    first = spark.createDataFrame(rows, "node long, did long, tk long, bits array<long>, keys array<long>")
    docs = spark.createDataFrame([(i, 7 * i, t) for i, t in enumerate(texts)], "did long, tk long, text string")
    got = {r["node"]: r["root"] for r in simhash._near_copies(first, docs, sketch).collect()}
    assert {n: got.get(n, n) for n in names} == dict(zip(names, root, strict=True))


def test_sketches_against_similarity(prose):
    """Of short texts the sketches tell the similarity itself; of long ones none at 0.8 or above is turned away, and few below 0.65 pass."""
    import numpy as np

    rng = random.Random(8)
    texts = [prose(1, n, words=3000).split() for n in (30, 120, 250, 900) for _ in range(1)]
    short = long = 0
    for words in texts:
        copies = []
        for k in range(120):
            other = list(words)
            for _ in range(rng.randrange(0, 2 + len(words) // 12)):
                other[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            copies.append(" ".join(other))
        made = [simhash.sketch_of(t, 256) for t in copies]
        sketches = simhash.Sketches(np.array([n for n, _ in made]), [k.view("<i4") for _, k in made], 256)
        i = np.arange(119)
        got = sketches.pass_(i, i + 1)
        want = np.array([jaccard(copies[a], copies[a + 1]) for a in i])
        assert got[want >= 0.8].all()
        if len(words) < 256:
            short += (want < 0.8).sum()
            assert (got & (want < 0.77)).sum() == 0
        else:
            long += (want < 0.65).sum()
            assert (got & (want < 0.62)).sum() <= 2
    assert short > 20 and long > 5


def test_links_that_sketches_turn_away_are_not_shown():
    """A text far from all others costs no link; the other links stay."""
    import numpy as np

    one, far = np.arange(100, dtype="<i4"), np.arange(1000, 1100, dtype="<i4")
    sketches = simhash.Sketches(np.full(4, 100), [one, one + 1, far, one + 2], 256)
    i, j = np.triu_indices(4, 1)
    node, other, bits, dead = simhash._forest(4, i, j, np.array([100, 90, 100, 90, 100, 90]), 80, sketches)
    assert {frozenset(x) for x in zip(node.tolist(), other.tolist())} <= {frozenset(x) for x in ((0, 1), (0, 3), (1, 3))} and len(node) == 2
    assert {(int(a), int(b)) for a, b in zip(i[dead], j[dead])} == {(0, 2), (1, 2), (2, 3)}
