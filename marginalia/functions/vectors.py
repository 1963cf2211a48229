"""Vector columns: distance, normalising, resizing, literals. All native higher-order functions.

Spark 4.1 may evaluate a lambda wrongly when one projection holds the same expression twice, so
callers put a distance in a column of its own before they use it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    """A vector known to the driver, as a constant of the plan."""
    return F.array(*[F.lit(float(x)) for x in values])


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; null if either is null or widths differ."""
    squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    # The outer lambda binds the norm, which would be found again for each element otherwise.
    over = lambda n: F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))
    return F.get(F.transform(F.array(norm(v)), over), F.lit(0))


def resize(v: Column, width: int) -> Column:
    """Cut or padded with zeros to ``width``, not normalised."""
    d = as_doubles(v)
    return F.slice(F.concat(d, F.array_repeat(F.lit(0.0), width)), 1, width)


def to_literal(v: Column) -> Column:
    """``[0.12345678,...]`` with 8 decimals, rounded as C does: the exact value, halves to the even digit; nulls are left out."""
    # format_string would round the shortest decimal form instead, halves up.
    def one(x: Column) -> Column:
        plain = F.call_function("format_number", x, F.lit("0.00000000"))
        return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(as_doubles(v), one), ","), F.lit("]"))


def from_literal(s: Column) -> Column:
    """A vector from its literal, in single precision."""
    return F.from_json(s, "array<float>")


def stored(v: Column) -> Column:
    """What storing a vector does to it: 8 decimals, then single precision."""
    return F.transform(as_doubles(v), lambda x: F.round(x, 8).cast("float"))


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded, halves away from zero, where ``x * 10^digits`` fits 53 bits; Spark's own rounding goes by way of decimals."""
    unit = float(10**digits)
    return F.when(x < 0, -F.floor(-x * unit + 0.5)).otherwise(F.floor(x * unit + 0.5)) / unit
