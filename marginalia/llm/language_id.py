"""Operator 5, language ID: string kernels with Nystroem landmarks and kernel ridge regression.

The kernel of two texts is their blended spectrum: how many distinct n-grams of 1 to 3 symbols they
share, divided by the root of the product of their own numbers. Symbols are the bytes of the
lower-cased text folded to 6 bits: a letter, any other ASCII byte, or the low bits of a non-ASCII
byte. Landmarks are labelled texts, as many of each language; a text's features are its kernels
with them times the inverse root of the landmarks' own kernel matrix. One ridge regression per
language (target 1, or 0 for the rest) is solved from summed normal equations. Batches of texts
are scored by a product of their presence matrix with the landmarks'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, free_names, materialise, release_memory, small_batches

#: The bound of the sample of labelled rows that a model is fitted on (about), and of its landmarks.
TRAIN_ROWS, LANDMARKS = 6000, 160
#: Ridge.
RIDGE = 1e-3
#: Texts in one matrix product.
BATCH = 256
#: Where n-grams of 1, 2 and 3 symbols start in one numbering.
ORIGIN, SPACE = (0, 1 << 6, (1 << 6) + (1 << 12)), (1 << 6) + (1 << 12) + (1 << 18)

FOLD = np.zeros(256, dtype=np.int32)
FOLD[97:123] = np.arange(1, 27)
FOLD[128:] = 27 + (np.arange(128, 256) & 31)


class Grams:
    """Distinct n-grams of texts; keeps a scratch table so that nothing is sorted or cleared."""

    def __init__(self):
        self.last = np.zeros(SPACE, dtype=np.int32)

    def of(self, text: str) -> np.ndarray:
        s = FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        two = (s[:-1] << 6) | s[1:]
        codes = np.concatenate([s, two + ORIGIN[1], ((two[:-1] << 6) | s[2:]) + ORIGIN[2]])
        order = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = order
        return codes[self.last[codes] == order]


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text)))


@dataclass
class LanguageModel:
    """langs, and arrays of bounded size: LANDMARKS columns, n-grams of the landmarks as rows."""

    langs: list[str]
    row_of: np.ndarray
    presence: np.ndarray
    norms: np.ndarray
    root: np.ndarray
    weights: np.ndarray | None = None

    def features(self, texts: list[str], grams: Grams) -> np.ndarray:
        own = np.zeros((len(texts), len(self.presence) + 1), dtype=np.float32)
        norms = np.ones(len(texts))
        for k, text in enumerate(texts):
            codes = grams.of(text)
            own[k, self.row_of[codes]] = 1  # the last column takes what no landmark has
            norms[k] = max(1, len(codes))
        kernel = (own[:, :-1] @ self.presence) / np.sqrt(norms[:, None] * self.norms[None, :])
        return kernel @ self.root

    def predict(self, texts: list[str], grams: Grams) -> tuple[list[str], np.ndarray]:
        scores = self.features(texts, grams) @ self.weights
        best = scores.argmax(axis=1)
        return [self.langs[b] for b in best], np.clip(scores[np.arange(len(texts)), best], 0, 1)


def _landmark_model(langs: list[str], landmarks: list[np.ndarray]) -> LanguageModel:
    used = np.unique(np.concatenate(landmarks))
    row_of = np.full(SPACE, len(used), dtype=np.int32)
    row_of[used] = np.arange(len(used))
    presence = np.zeros((len(used), len(landmarks)), dtype=np.float32)
    for k, codes in enumerate(landmarks):
        presence[row_of[codes], k] = 1
    norms = np.array([max(1, len(c)) for c in landmarks], dtype=float)
    kernel = (presence.T @ presence).astype(float) / np.sqrt(norms[:, None] * norms[None, :])
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    return LanguageModel(langs, row_of, presence, norms, root)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Learn from the rows of ``docs`` where ``train`` holds and text and lang are not null.

    The sample takes rows by a hash of id and text, as many of each language as its share of
    ``TRAIN_ROWS`` allows (rare languages wholly). None if there is no such row.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.filter(train).select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), F.col(lang_col).cast("string").alias("lang"), text.alias("t"))
    rows = rows.filter("lang is not null and t is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    quota = max(1, TRAIN_ROWS // len(langs))
    every = F.create_map(*[F.lit(x) for lang in langs for x in (lang, max(1, sizes[lang] // quota))])
    sample = rows.filter(F.pmod("h", every[F.col("lang")]) == 0).limit(2 * TRAIN_ROWS + len(langs))
    sample = materialise(sample.repartition(12, "h"), "language-sample")

    each = max(1, LANDMARKS // len(langs))
    order = Window.partitionBy("lang").orderBy("h", "t")
    chosen = sample.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "k": b["k"], "codes": [grams.of(t).tobytes() for t in b["t"]]})

    found = chosen.select("lang", "k", "t").mapInPandas(codes, "lang string, k int, codes binary").collect()  # LANDMARKS rows
    found = [np.frombuffer(r["codes"], dtype=np.int32) for r in sorted(found, key=lambda r: (r["lang"], r["k"]))]
    model = _landmark_model(langs, [c for c in found if len(c)] or [np.zeros(1, dtype=np.int32)])
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, grams = shared.value, Grams()
        d = m.root.shape[1]
        gram, cross, place = np.zeros((d, d)), np.zeros((d, len(m.langs))), {x: i for i, x in enumerate(m.langs)}
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH]
                x = m.features(part["t"].tolist(), grams)
                y = np.zeros((len(part), len(m.langs)))
                y[np.arange(len(part)), [place[v] for v in part["lang"]]] = 1
                gram += x.T @ x
                cross += x.T @ y
        yield pd.DataFrame({"gram": [gram.tobytes()], "cross": [cross.tobytes()]})

    parts = sample.mapInPandas(sums, "gram binary, cross binary").collect()  # one row of fixed size for each of 12 parts
    d = model.root.shape[1]
    gram = sum(np.frombuffer(r["gram"]).reshape(d, d) for r in parts)
    cross = sum(np.frombuffer(r["cross"]).reshape(d, len(langs)) for r in parts)
    model.weights = np.linalg.solve(gram + RIDGE * len(parts) * np.eye(d), cross)
    return model


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more: the predicted language (``und`` for a null text or one without
    a letter, or if nothing was learned) and a score from 0 to 1. Only the text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = shared.value, Grams()
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if m and has_letter(t)]
            for a in range(0, len(known), BATCH):
                part = known[a : a + BATCH]
                found, scores[part] = m.predict([texts[k] for k in part], grams)
                for k, lang in zip(part, found):
                    langs[k] = lang
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], schema.names)
        release_memory()

    return docs.mapInArrow(run, schema)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows with crc32(id) mod 3 = 1 are held out.

    The model learns from the other rows. Null ids count as the empty text there. Repeated rows each
    come back; an empty table gives no rows; further columns are ignored.
    """
    fold = crc32_mod(F.col(id_col), 3)
    model = fit(docs, fold != 1, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == 1).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return predict(rows, model, "t").select("doc_id", "held_out", "lang_pred", "score")


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.25) -> DataFrame:
    """``docs`` without the rows that language ID rejects: ``und``, or a score below ``least``."""
    model = fit(docs, F.lit(True), id_col, text_col, lang_col)
    text, *names = free_names(docs, "t", "lang_pred", "score")
    kept = predict(docs.withColumn(text, F.col(text_col).cast("string")), model, text, tuple(names))
    return kept.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
