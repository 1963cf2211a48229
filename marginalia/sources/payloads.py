"""JSON bodies of pushes, with either spelling of their fields; first the one with underscores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = {"file_path": T.StringType(), "action": T.StringType(), "changed_at_unix_ms": T.LongType(), "content_base64": T.StringType(), "content_sha256": T.StringType()}
FILE = {"file_path": T.StringType(), "content_base64": T.StringType()}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    names = [n for f in fields for n in dict.fromkeys((f, _camel(f)))]
    kinds = {n: k for f, k in fields.items() for n in (f, _camel(f))}
    return T.StructType([T.StructField(n, kinds[n]) for n in names])


def _either(prefix: str, name: str) -> Column:
    return F.coalesce(*[F.col(f"{prefix}{n}") for n in dict.fromkeys((name, _camel(name)))]).alias(name)


def body_schema(list_name: str, fields: dict[str, T.DataType]) -> T.StructType:
    outer = _struct({"vault_uid": T.StringType(), "device_id": T.StringType(), "uploaded_at_unix_ms": T.LongType()})
    return T.StructType([*outer.fields, T.StructField(list_name, T.ArrayType(_struct(fields)))])


def _exploded(bodies: DataFrame, list_name: str, fields: dict[str, T.DataType]) -> DataFrame:
    head = [_either("", n) for n in ("vault_uid", "device_id", "uploaded_at_unix_ms")]
    rows = bodies.select(*head, F.posexplode_outer(list_name).alias("seq", "x"))
    return rows.select("vault_uid", "device_id", "uploaded_at_unix_ms", "seq", *[_either("x.", n) for n in fields])


def read_pushes(spark: SparkSession, path: str) -> DataFrame:
    """The changes of push bodies (a JSON object a line), one row each, in order ``seq``."""
    return _exploded(spark.read.schema(body_schema("changes", CHANGE)).json(path), "changes", CHANGE)


def read_full_pushes(spark: SparkSession, path: str) -> DataFrame:
    """The files of full-push bodies, one row each; an empty list gives a row without a path."""
    return _exploded(spark.read.schema(body_schema("files", FILE)).json(path), "files", FILE)


def parse_full_pushes(bodies: DataFrame, text_col: str) -> DataFrame:
    """The same from a column of JSON text."""
    parsed = bodies.select(F.from_json(text_col, body_schema("files", FILE)).alias("b")).select("b.*")
    return _exploded(parsed, "files", FILE)


def parse_pushes(bodies: DataFrame, text_col: str) -> DataFrame:
    """The same from a column of JSON text."""
    parsed = bodies.select(F.from_json(text_col, body_schema("changes", CHANGE)).alias("b")).select("b.*")
    return _exploded(parsed, "changes", CHANGE)
