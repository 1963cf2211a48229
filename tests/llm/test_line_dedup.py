import re

import pytest

from marginalia.llm.line_dedup import template_line_dedup


def run(docs, **k):
    return [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in template_line_dedup(docs, **k).collect()]


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = template_line_dedup(docs, min_docs=2)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    got = run(docs, min_docs=2)
    assert len(got) == len(odd_rows)
    assert [g for g in got if g[0] == 4] == [(4, "same text here today", 1, 0)] * 2  # the owner, twice
    assert [g for g in got if g[0] == 5] == [(5, "", 1, 1)]
    kept = {i: t for i, t, _ in odd_rows if i not in (None, 5)}
    assert all(t == kept[i] for i, t, _, _ in got if i in kept)
    assert {g[1:] for g in got if g[0] is None} == {("no id has this text at all", 1, 0), (None, 0, 0)}


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def test_templates_with_fields(make_docs):
    lines = ["Posted in the room by {} on 2024-01-{:02d} for all who read", "all rights are reserved by the {} company of this place and time"]
    names = ["anna", "bert", "cleo", "dora", "emil"]
    rows = [(i, f"own line {n} of doc alone\n{lines[0].format(n, i + 1)}\n{lines[1].format(n)}", "en") for i, n in enumerate(names)]
    got = dict((g[0], g[1]) for g in run(make_docs(rows)))
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own line {names[i]} of doc alone" for i in range(1, 5))


def test_rare_and_short_lines_stay(make_docs):
    rows = [(i, f"ok then\nthis line is in two documents {i // 2}x{'ab'[i // 2 % 2]}\nunique{i} words go here {i}q", "en") for i in range(4)]
    assert all(g[3] == 0 for g in run(make_docs(rows), min_docs=5))
    two = [(1, "alpha beta gamma delta", "en"), (2, "alpha beta gamma delta", "en")]
    assert all(g[3] == 0 for g in run(make_docs(two)))


def brute(rows, min_docs, min_tokens):
    """Exact lines only, for texts without near lines or digits."""
    tokens = lambda line: re.sub(r"\s+", " ", line).strip()
    owners = {}
    for i, t, _ in rows:
        for line in t.split("\n"):
            if len(tokens(line).split(" ")) >= min_tokens:
                owners.setdefault(tokens(line), set()).add(i)
    drop = {x: min(o) for x, o in owners.items() if len(o) >= min_docs}
    return {i: "\n".join(x for x in t.split("\n") if drop.get(tokens(x), i) >= i) for i, t, _ in rows}


@pytest.mark.parametrize("min_docs", [2, 3])
def test_against_brute_force(make_docs, min_docs):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pool = [" ".join(word() for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), "en") for i in range(80)]
    assert {g[0]: g[1] for g in run(make_docs(rows), min_docs=min_docs)} == brute(rows, min_docs, 3)


def test_hot_line(make_docs):
    rows = [(i, f"a very common line stands here\nown words {chr(97 + i % 26)}{chr(97 + i // 26)} only", "en") for i in range(300)]
    got = run(make_docs(rows))
    assert sum(g[3] for g in got) >= 299 and [g[3] for g in got if g[0] == 0] == [0]


def test_character_counts_follow(make_docs):
    rows = [(i, f"boiler plate line of text é\nown {chr(97 + i)} words", "en") for i in range(5)]
    out = template_line_dedup(make_docs(rows), count_col="n_chars").collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_long_lines_go_from_two_documents_on(make_docs):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pool = [" ".join(word() for _ in range(rng.choice([4, 20, 49, 50, 51, 90]))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))), "en") for i in range(40)]
    short, long = ([x for x in pool if (len(x.split()) >= 50) == k] for k in (False, True))
    docs_of = lambda x: [i for i, t, _ in rows if x in t.split("\n")]
    assert any(len(docs_of(x)) == 2 for x in short) and any(len(docs_of(x)) == 2 for x in long)
    owner = {x: min(docs_of(x)) for x in pool if len(docs_of(x)) >= (3 if x in short else 2)}
    want = {i: "\n".join(x for x in t.split("\n") if owner.get(x, i) >= i) for i, t, _ in rows}
    assert {g[0]: g[1] for g in run(make_docs(rows))} == want


def test_a_leaf_with_many_templates(make_docs):
    """Unique copies of a template are found after any number of more frequent lines of their leaf."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lead = "we hereby state"
    frequent = [f"{lead} {' '.join(word() for _ in range(12))}" for _ in range(15)]
    fields = [[word() for _ in range(12)] for _ in range(3)]  # three templates, each copy with two words of its own
    copies = [[f"{lead} {' '.join([word(), *f[1:7], word(), *f[8:]])}" for _ in range(6)] for f in fields]
    rows = [(i, x, "en") for i, x in enumerate([*frequent, *frequent, *frequent, *[c for cs in copies for c in cs]])]
    got = {g[0]: g[3] for g in run(make_docs(rows))}
    assert got == {i: int(i >= 15 and (i - 45) % 6 != 0) if i >= 45 else int(i >= 15) for i in got}


def test_buckets_hold_all_similar_pairs(spark):
    import random
    from itertools import combinations

    from pyspark.sql import functions as F

    from marginalia.llm.line_dedup import _buckets

    rng = random.Random(8)
    lines = []
    for m in range(4, 24):
        base = [*"abc", *(rng.choice("xyzuvw") for _ in range(m - 3))]
        for _ in range(12):
            t = list(base)
            for k in range(3, m):
                if rng.random() < 0.15:
                    t[k] = rng.choice("xyzuvw")
            lines.append((len(lines), m, len(lines), t))
    left = spark.createDataFrame(lines, "h long, leaf long, rank long, tokens array<string>")
    held = {r["h"]: set(r["b"]) for r in _buckets(left, 3, 0.8).groupBy("h").agg(F.collect_set("bucket").alias("b")).collect()}
    close = [(a[0], b[0]) for a, b in combinations(lines, 2) if a[1] == b[1] and sum(x == y for x, y in zip(a[3], b[3])) >= 0.8 * a[1]]
    assert close and all(held[a] & held[b] for a, b in close)


def brute_templates(rows, depth=3, similarity=0.8, min_docs=3, min_tokens=3, long_tokens=50):
    """Single-file passes over each leaf, in the order of founders' ranks."""
    import xxhash

    shape = lambda line: re.sub(r"\s+", " ", re.sub(r"\S*[0-9]\S*", "<*>", line)).strip()
    docs_of, template = {}, {}
    for i, t, _ in rows:
        for line in t.split("\n"):
            if len(shape(line).split(" ")) >= min_tokens and shape(line):
                docs_of.setdefault(shape(line), set()).add(i)
    leaves = {}
    for x in docs_of:
        leaves.setdefault((len(x.split(" ")), *x.split(" ")[:depth]), []).append(x)
    rank = lambda x: (len(docs_of[x]), xxhash.xxh64_intdigest(x.encode(), 42) & (1 << 24) - 1)
    for leaf in leaves.values():
        left = sorted(leaf, key=rank, reverse=True)
        while left:
            model = left[0].split(" ")
            took = [x for x in left if sum(a == b for a, b in zip(x.split(" "), model)) >= similarity * len(model)]
            template |= dict.fromkeys(took, left[0])
            left = [x for x in left if x not in took]
    holders = {}
    for x, t in template.items():
        holders.setdefault(t, set()).update(docs_of[x])
    need = lambda t: min_docs if len(t.split(" ")) < long_tokens else 2
    owner = {t: min(ids) for t, ids in holders.items() if len(ids) >= need(t)}
    return {i: "\n".join(x for x in t.split("\n") if owner.get(template.get(shape(x)), i) >= i) for i, t, _ in rows}


@pytest.mark.parametrize("max_templates", [0, 8])
def test_templates_against_brute_force(make_docs, max_templates):
    """Lines with variable fields in shared leaves, up to 14 templates of four copies in one."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    copies = []
    for lead, n, size in (("we hereby state", 14, 15), ("read on here", 3, 10), ("all of this", 2, 55)):
        for _ in range(n):
            base = [word() for _ in range(size - 3)]
            for k in range(4):
                line = list(base)
                for _ in range(rng.randrange(0, 2)):
                    line[rng.randrange(len(line))] = word() if k % 2 else f"{rng.randrange(99)}"
                copies.append(" ".join([lead, *line]))
    rng.shuffle(copies)
    rows = [(i, "\n".join([f"own words of {word()} {word()}", *copies[2 * i : 2 * i + 2]]), "en") for i in range(len(copies) // 2)]
    got, want = {g[0]: g[1] for g in run(make_docs(rows), max_templates=max_templates)}, brute_templates(rows)
    assert got == want and sum(len(t) for t in want.values()) < 0.5 * sum(len(t) for _, t, _ in rows)


@pytest.mark.parametrize("max_templates", [0, 1, 8])
def test_lines_between_templates_join_the_higher_ranked_one(make_docs, max_templates):
    """Crowded leaves of lines that are similar to several others: whatever the passes, templates are those of single file."""
    import random

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for leaf in range(40):
        base = [f"{'abcdefghij'[leaf % 10]}lead", "of", f"leaf{'klmn'[leaf // 10]}", *[word() for _ in range(12)]]
        spare = [[word() for _ in range(3)] for _ in range(15)]
        for _ in range(30):
            line = list(base)
            for k in rng.sample(range(3, 15), rng.randrange(0, 6)):
                line[k] = rng.choice(spare[k])
            rows.append((len(rows), "\n".join([" ".join(line), f"own {word()} {word()}"]), "en"))
    got, want = {g[0]: g[1] for g in run(make_docs(rows), min_docs=5, max_templates=max_templates)}, brute_templates(rows, min_docs=5)
    assert got == want and sum(t.count("\n") == 0 for t in want.values()) > 300


def test_bucket_passes_read_waiting_lines_only(make_docs, monkeypatch):
    """Lines that have a template, and those of small leaves, aren't read again with every pass of a large one."""
    from marginalia.llm import line_dedup as m

    read, store = [], m.materialise
    monkeypatch.setattr(m, "materialise", lambda df, name: (name == "line-took" and read.append(df.inputFiles()), store(df, name))[1])
    monkeypatch.setattr(m, "LEAF_LINES", 8)
    leads = {"we hereby state": 12, "read this on": 4, "all of it": 5}  # only the first leaf is passed over by buckets
    words = ["".join("abcdefgh"[i // 8**k % 8] for k in range(4)) for i in range(300)]
    lines = [" ".join([lead, *words[100 * n + 8 * k :][:8]]) for n, (lead, size) in enumerate(leads.items()) for k in range(size)]
    got = {g[0]: g[3] for g in run(make_docs([(3 * i + k, x, "en") for i, x in enumerate(lines) for k in range(3)]))}
    assert got == {i: int(i % 3 > 0) for i in range(63)}
    assert read and not [f for files in read for f in files if "line-texts" in f]


def test_map_of_documents_holds_all_wanted_and_few_others(spark):
    """Texts are taken apart again only of documents that a needed line is read from."""
    from pyspark.sql import functions as F

    from marginalia.llm.line_dedup import _holding

    base = spark.range(-20_000, 20_000).select(F.col("id").alias("did"), F.lit(0).cast("long").alias("tk"), F.lit("x").alias("body"))
    got = {r["did"] for r in _holding(base, base.filter("did % 100 = 0").select("did", F.explode(F.array(F.lit(1), F.lit(2))).alias("h"))).collect()}
    assert got >= set(range(-20_000, 20_000, 100)) and len(got) < 420
    assert _holding(base, base.limit(0)).count() == 0


def test_lines_that_go_cost_as_much_as_their_text(make_docs):
    """A text is split once, not once for each of its lines."""
    import time

    rows = [(i, "\n".join([x for k in range(12_000) for x in (f"{'abcdefghij'[i]} own of {k:x}", "one line for all of them to share")]), "en") for i in range(4)]
    docs = make_docs(rows)
    run(docs.limit(1))
    began = time.time()
    got = {g[0]: (g[2], g[3]) for g in run(docs)}
    took = time.time() - began
    assert got == {i: (24_000, 12_000 if i else 0) for i in got} and len(got) == 4
    print(f"{took:.1f} s")
    assert took < 20
