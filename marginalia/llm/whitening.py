"""Operator 11, embedding whitening: one-sided Jacobi singular value decomposition.

Vectors become whole numbers, so that sums and centred rows are exact. Every task compresses its
centred rows block by block to a triangle R with the same products of columns (TSQR); the tasks'
triangles are stacked and compressed again in groups of ``FAN``, level by level, until one is left.
Its columns are made orthogonal by plane rotations; the rotations, multiplied up, are the
components, and the lengths of the rotated columns their standard deviations. The covariance matrix
is never formed for this, which would square the condition number.

A last pass over all rows measures the covariance of the whitened vectors: each block is centred by
its own mean, and blocks are merged with the correction for their means' difference.

Tables of a row for each task are stored; what comes to the driver is one triangle, of the vector's
width, and sums of that width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Vectors become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Blocks that one task of a level compresses together.
FAN = 16
STATE = "block long, n long, mean array<double>, m array<double>"


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as rows) of a matrix, by one-sided rotations.

    Columns are paired as in a round-robin tournament, so that all pairs of a round are disjoint and
    rotate at once. Columns of no length beside the longest count as orthogonal.
    """
    d = r.shape[1]
    a, v = np.ascontiguousarray(r.T, dtype=np.float64), np.eye(d)
    eps, order, half = np.finfo(float).eps, np.arange(d + d % 2), (d + 1) // 2
    none = (a * a).sum(axis=1).max(initial=0.0) * (eps * d) ** 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[:half], order[half:][::-1]
            real = (p < d) & (q < d)  # an odd number of columns: one sits out
            p, q = p[real], q[real]
            alpha, beta, gamma = (a[p] ** 2).sum(axis=1), (a[q] ** 2).sum(axis=1), (a[p] * a[q]).sum(axis=1)
            go = (np.abs(gamma) > eps * np.sqrt(alpha * beta)) & (np.minimum(alpha, beta) > none)
            if go.any():
                turned = True
                p, q = p[go], q[go]
                zeta = (beta[go] - alpha[go]) / (2 * gamma[go])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                c, s = c[:, None], (c * t)[:, None]
                a[p], a[q] = c * a[p] - s * a[q], s * a[p] + c * a[q]
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
            order[1:] = np.roll(order[1:], 1)
        if not turned:
            break
    sizes = np.sqrt((a * a).sum(axis=1))
    by = np.argsort(-sizes, kind="stable")
    return sizes[by], v[by]


def compressed(r: np.ndarray) -> np.ndarray:
    """The triangle of a stack of rows; fewer rows than columns stay as they are."""
    return np.linalg.qr(r, mode="r") if len(r) > r.shape[1] else r


def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(n, mean, centred products) of several sets of rows, from those of each."""
    out = None
    for n, mean, m in parts:
        if out is None:
            out = n, mean, m
            continue
        n0, mean0, m0 = out
        step, total = mean - mean0, n0 + n
        out = total, mean0 + step * (n / total), m0 + m + np.outer(step, step) * (n0 * n / total)
    return out


def _row(block: int, n: int, mean: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": [block], "n": [n], "mean": [mean.ravel()], "m": [m.ravel()]})


def _tree(blocks: DataFrame, fold: Callable[[pd.DataFrame], tuple[int, np.ndarray, np.ndarray]]):
    """The one row that is left of ``blocks`` (STATE, numbered from 0), ``FAN`` at a time; None if there are none."""
    blocks = materialise(blocks, "white-blocks")
    top = blocks.agg(F.max("block")).first()[0]

    def level(group: pd.DataFrame) -> pd.DataFrame:
        return _row(int(group["block"].iloc[0]) // FAN, *fold(group.sort_values("block")))

    while top:  # more than block 0
        blocks = materialise(blocks.groupBy(F.floor(F.col("block") / FAN)).applyInPandas(level, STATE), "white-blocks")
        top //= FAN
    return blocks.first()


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and component.

    Vectors that are null or hold a null or non-finite entry are left out, and so are those of
    another width than most (of two widths as frequent: than the smaller one). A component without
    variance, as all of them for a single vector or for equal ones, has whitened null and explained 0
    (null if no component has any), and takes no part in identity_error, null without components.
    deviation is null where it exceeds a long. Rows with a null id and repeated rows are rows like
    others. An empty table gives no rows; entries whose whole number exceeds a long raise an error.
    Further columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.when(good, v), lambda c: F.floor(c * SCALE) + SHIFT).alias("x")).filter("x is not null")
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if widths is None or not widths["w"]:
        return spark.createDataFrame([], out)
    width, n = widths["w"], widths["n"]
    rows = rows.filter(F.size("x") == width)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, dtype=np.int64)
        for b in batches:
            if len(b):
                total += _stacked(b["x"]).sum(axis=0)
        yield pd.DataFrame({"pos": np.arange(width), "s": total})

    by_pos = rows.select("x").mapInPandas(sums, "pos int, s long").groupBy("pos").agg(F.sum("s").alias("s")).orderBy("pos")
    s = np.array([r["s"] for r in by_pos.collect()], dtype=np.int64)  # a row a dimension

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for b in batches:
            if len(b):
                r = compressed(np.vstack([r, (n * _stacked(b["x"]) - s).astype(np.float64)]))
        if len(r):
            yield _row(TaskContext.get().partitionId(), len(r), np.zeros(0), r)

    def stack(group: pd.DataFrame):
        r = compressed(np.vstack([np.asarray(m).reshape(-1, width) for m in group["m"]]))
        return len(r), np.zeros(0), r

    last = _tree(rows.select("x").mapInPandas(triangles, STATE), stack)
    sizes, axes = jacobi(compressed(np.asarray(last["m"]).reshape(-1, width)))
    variance = (sizes / n) ** 2 / n
    some = sizes > sizes[0] * width * np.finfo(float).eps
    k = min(components, width)
    real = int(some[:k].sum())
    over = (axes[:real] / np.sqrt(variance[:real])[:, None]).T / n  # from n * x - S to whitened entries
    explained = (variance[:k] / variance.sum()).tolist() if real else [None] * k

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks():
            for b in batches:
                if len(b):
                    w = (n * _stacked(b["x"]) - s) @ over
                    mean = w.mean(axis=0)
                    yield len(w), mean, (w - mean).T @ (w - mean)

        if (got := merged(blocks())) is not None:
            yield _row(TaskContext.get().partitionId(), *got)

    def merge(group: pd.DataFrame):
        return merged((r.n, np.asarray(r.mean), np.asarray(r.m).reshape(real, real)) for r in group.itertuples())

    error = None
    if real:
        last = _tree(rows.select("x").mapInPandas(products, STATE), merge)
        error = float(np.abs(np.asarray(last["m"]).reshape(real, real) / n - np.eye(real)).max())

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            c = n * _stacked(b["x"]) - s
            fits = (c.astype(np.float64) ** 2).sum(axis=1) < 2.0**62
            squares = [int(q) if ok else None for q, ok in zip((c * c).sum(axis=1), fits, strict=True)]
            white = np.full((len(b), k), np.nan)
            white[:, :real] = c @ over
            yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": pd.array(squares, dtype="Int64"), "w": list(white)})

    made = rows.mapInPandas(emit, "vec_id long, deviation long, w array<double>")
    made = made.select("vec_id", "deviation", F.posexplode("w").alias("k", "w"))
    share = F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("k"))
    return made.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("k") < real, F.col("w")).alias("whitened"),
        share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
