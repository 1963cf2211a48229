"""Text steps of keypoints: which characters they know, and what they cost beside one plain search."""

import time

import markdown_rules as rules
from pyspark.sql import functions as F

from marginalia.functions import markdown, text


def test_every_mark_and_blank_is_known(spark):
    rows = [(n, f"a{chr(n)}b {chr(n)} c{chr(n)}") for n in range(1, 0x3100)]
    df = spark.createDataFrame(rows, "n int, t string")
    got = df.select("n", "t", text.inline_normalised(F.col("t")).alias("x"), text.nfc(F.col("t")).alias("y"), F.split("t", markdown.LINE_END).alias("z"), text.sentences(F.col("t")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["x"] == rules.inline(r["t"]), hex(r["n"])
        assert r["y"] == rules.nfc(r["t"]), hex(r["n"])
        assert r["z"] == rules.LINE_END.split(r["t"]), hex(r["n"])
        assert r["s"] == rules.sentences(r["t"]), hex(r["n"])


def test_again_is_the_whole_rule(spark):
    pieces = ["[a [b](c)](d)", "x [[[y](z)]]", "`a` b`", "[[T|A]] c", "no marks. Two", "[a](b", "[[a](b)", "[[a|b](c)]]", "!"]
    df = spark.createDataFrame([(p,) for p in pieces], "t string").select(text.inline_normalised(F.col("t")).alias("t"))
    got = df.select(text.inline_normalised(F.col("t")).alias("x"), text.normalised_again(F.col("t")).alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got]


def test_plain_prose_costs_few_searches(spark):
    words = ["plain", "sentence", "of", "many", "words", "without", "any", "marks", "hier"]
    body = " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words * 300))
    df = spark.range(0, 1600, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(" " + body)).alias("t")).cache()
    df.count()

    def took(c):
        best = 1e9
        for _ in range(3):
            began = time.time()
            df.select(c.alias("c")).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    steps = F.transform(text.sentences(text.inline_normalised(F.col("t"))), text.nfc)
    one, all_steps = took(F.regexp_replace("t", "[0-9;]", " ")), took(steps)
    df.unpersist()
    print(f"one search {one:.3f} s, all steps {all_steps:.3f} s")
    assert all_steps < 10 * one


def test_normalised_texts_have_the_same_sentences(spark):
    """Normalised texts are cut without a search for other white space than spaces, with the same result."""
    pieces = ["One. 2 Two! 0 1. 3", "\ta\x0bb. c\r.\xa0d\u2003.", "\x850. \u3000x\u2029! \u1680", "é. ü; 。だ", " ", ".", "0 . 1 . 2", "*_a_*. ~b", "\x1c a. \x1f"]
    df = spark.createDataFrame([(p,) for p in pieces], "t string").select("t", text.inline_normalised(F.col("t")).alias("x"))
    got = df.select("t", "x", text.sentences(F.col("x")).alias("a"), text.sentences(F.col("x"), normalised=True).alias("b")).collect()
    assert all(r["x"] == rules.inline(r["t"]) and r["a"] == r["b"] == rules.sentences(r["x"]) for r in got), got
