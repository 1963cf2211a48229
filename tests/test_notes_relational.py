"""Notes as relations against the same rules line by line."""

import random

import markdown_rules as rules
import pytest
from pyspark.sql import functions as F

from marginalia.functions import markdown, text
from marginalia.operators import notes
from marginalia.schema import BLOCK_END, BLOCK_START

LINES = [
    "# One", "## Two *x*", "### Three", "####### seven", "#no", "# ", "# **", "  ## Indented", "- item one", "- [ ] task", "* ", "+ plus", "1. first", "22) second", "٣. arabic", "> quote", ">", "> > deep",
    "| a | b |", "|---|:-:|", "|- x | y", "| only |", "a | b", "|", "```", "```python", "~~~", "", "   ", "\t", "Plain text. With two sentences", "and a tail!", "wait...", "v1.2 is out; really?", "[[Target|Alias]] and ![[Embed]]",
    "[[ T | ]] [a](u) `code` _em_", "---", "***", "same line", "same line", "title: Not front", "é combining and é", "한글 자모", "é" * 430, "x" * 425 + " y", "Å Å", "One: starts like its heading", "👩‍👩‍👧 family", "日本。終わり", " wide blank ",
]


def cases():
    rng = random.Random(11)
    heads = ["", "", "---\ntitle: Named\n---\n", "---\nTITLE :  Other \ntitle:\ntags: a\n---\n", "---\nopen\n", "---\n---\n", "---\ntitle: a\ntitle: b: c\n---", "--- \ntitle: x\n---\n"]
    ends = ["\n", "\n", "\r\n", "\r", " ", "\x0b"]
    out = ["", "\n\n", "# A\n## B", "```\nhi there\n```", "---", "\n".join(f"- item {i}" for i in range(129)), "# H\n" + "\n".join(f"s{i}. t{i}." for i in range(90)), "x\n```\ncode\n", "_", "# A\n\n- one\n- two\n"]
    out += [f"a\n\n{BLOCK_START}\n- [[x]]\n{BLOCK_END}\n\n\n\nb\r\nc", f"{BLOCK_START}{BLOCK_END}", f"{BLOCK_END} {BLOCK_START} t", f"t\n{BLOCK_START}", f" p {BLOCK_START} q {BLOCK_END} r {BLOCK_START} s {BLOCK_END}\n"]
    for _ in range(250):
        lines = [rng.choice(LINES) for _ in range(rng.randrange(1, 18))]
        body = "".join(x + rng.choice(ends) for x in lines)
        out.append(rng.choice(heads) + (body if rng.random() < 0.5 else body.rstrip("\n")))
    return out


def test_parsed_notes_equal_the_rules(spark):
    texts = cases()
    paths = ["x/My Note.md", "d/e.f.MD", "é\\ü.md", "_.md", "noext", "d/.md"]
    rows = [(i, i % 3, paths[i % len(paths)], t) for i, t in enumerate(texts)] + [(10_000, 1, "n.md", None)]
    df = spark.createDataFrame(rows, "id long, vault_id long, file_path string, content string")
    got = {r["id"]: r for r in markdown.parsed_notes(df).collect()}
    assert len(got) == len(rows)
    for i, vault, path, t in rows:
        base = rules.without_block(t or "")
        title = rules.title_of(path, base)
        points = rules.keypoints(base, title)
        r = got[i]
        assert (r["vault_id"], r["file_path"]) == (vault, path)
        assert (r["title"], r["keypoints"], r["summary"]) == (title, points, "\n".join(points) or title), repr(t)


def test_documents_equal_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("a/b.md").alias("file_path"), F.col("text").alias("content"))
    got = {r["id"]: (r["title"], r["keypoints"]) for r in markdown.parsed_notes(docs).collect()}
    for r in docs.collect():
        title = rules.title_of("a/b.md", rules.without_block(r["content"] or ""))
        assert got[r["id"]] == (title, rules.keypoints(rules.without_block(r["content"] or ""), title))


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, 1, "a.md", "# x", False)], "id long, vault_id long, file_path string, content string, is_deleted boolean")
    links = spark.createDataFrame([], "file_a_id long, file_b_id long, similarity double")
    for made in (notes.keypoint_rows(notes.parse(df)), notes.rewrites(df, links)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("related", [None, [], ["b.md", "b.md", "d\\c.md"], ["é/x.y.md", "noext"]])
def test_blocks_equal_the_rules(spark, related):
    rows = [(i, t, related) for i, t in enumerate(cases()[:60])] + [(999, None, related)]
    df = spark.createDataFrame(rows, "i long, t string, r array<string>")
    got = {r["i"]: (r["w"], r["o"]) for r in df.select("i", markdown.with_block(F.col("t"), F.col("r")).alias("w"), markdown.without_block(F.coalesce("t", F.lit(""))).alias("o")).collect()}
    for i, t, _ in rows:
        assert got[i] == (rules.with_block(t or "", related or []), rules.without_block(t or "")), repr(t)


def test_composition(spark):
    words = ["plain", "é", "é", "한", "Å", "Ａ", "ｶﾞ", "ガ", "क़", "", None, "q̣̇"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["x"] for r in df.select(text.nfc(F.col("w")).alias("x")).collect()] == [None if w is None else rules.nfc(w) for w in words]


def test_a_related_note_without_a_path_is_no_link(spark):
    rows = spark.createDataFrame([("x", [None]), ("x", ["a.md", None]), ("x", None)], "t string, r array<string>")
    made = [r[0] for r in rows.select(markdown.with_block(F.col("t"), F.col("r"))).collect()]
    assert made[0] == made[2] == "x\n" and made[1].count("- [[") == 1
