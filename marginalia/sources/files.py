"""Files in any store that Spark reads, through the Hadoop file system; from the driver, for names and small files."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def store(spark: SparkSession, path: str):
    """(file system, path) on the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it isn't there."""
    fs, at = store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder, if it is there."""
    fs, at = store(spark, path)
    fs.delete(at, True)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Write a small file under another name and move it into place, so that readers see all of it or nothing."""
    fs, at = store(spark, path)
    part = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(store(spark, part)[1], True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if not fs.rename(store(spark, part)[1], at):  # it is there: a repeated run
        fs.delete(at, False)
        fs.rename(store(spark, part)[1], at)


def read_json(spark: SparkSession, path: str) -> Any:
    """A small file's value; None if it isn't there."""
    fs, at = store(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)
