import random

import pytest

#: Names that operators use inside, as further columns of an input.
CLASHES = ["did", "tk", "t", "h", "key", "fold", "link", "shard", "slot", "size", "bucket", "rank", "part", "n_lines", "score", "lang_pred", "fp", "root", "node", "block", "items", "starts", "sample", "ids", "batch", "text_crc32", "row", "drops", "body", "pos", "bits", "keys", "__did", "__tk", "__drops", "__score", "__lang_pred", "__t", "__row"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text, lang) rows, with columns whose names clash."""

    def make(rows):
        full = [(i, t, lang, "src", len(t) if t is not None else None, *range(len(CLASHES))) for i, t, lang in rows]
        ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES)
        return spark.createDataFrame(full, ddl)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, repeated, and very long texts; texts of other scripts; special strings."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [
        (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "same text here today", "en"), (4, "same text here today", "en"), (5, "same text here today", None),
        (None, "no id has this text at all", "en"), (None, None, None), (6, long, "en"), (7, "日本語 😀 ok\r\nzwei\x0bdrei", "de"), (8, "12345 !!!", "fr"),
        (9, "a <|endoftext|> b  c\xa0d é", "fr"), (10, "x" * 3000, "fr"), (11, "\n\n\n", "de"), (12, " lead and trail ", "de")]


@pytest.fixture(scope="session")
def prose():
    """Random sentences; ``prose(seed, n)`` gives n words."""

    def make(seed, n, words=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(words)}" for _ in range(n))

    return make
