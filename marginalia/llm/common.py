"""Shared folder, session settings and column helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local-mode session (one machine, as in tests) may leave it unset; then a temporary
    folder is made once for the session. The tables of an application lie in a folder of their own,
    which goes when the application ends.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("marginalia.shared.dir", None)
    if not folder:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("marginalia.shared.dir", folder)
    own = f"{folder.rstrip('/')}/marginalia-llm-{spark.sparkContext.applicationId}"
    if spark.conf.get("marginalia.llm.own", None) != own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.conf.set("marginalia.llm.own", own)
    return own


_working: list[dict[str, DataFrame]] = []  # the tables of each `working_tables` that is open


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage; the table outlives any executor. Empty frames keep their schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _working:
        _working[-1][path] = out
    return out


@contextlib.contextmanager
def working_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialised inside are removed at the end, but for those given to what this yields.

    For steps whose result reads a few of the tables that they store: the kept ones.
    """
    made: dict[str, DataFrame] = {}
    _working.append(made)

    def keep(df: DataFrame) -> DataFrame:
        for path in [p for p, t in made.items() if t is df]:
            del made[path]
        return df

    try:
        yield keep
    finally:
        _working.remove(made)
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, in rows and in bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release_memory() -> None:
    """Give a Python worker's free memory back at a task's end: workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """(did, tk): what tells rows apart when results are joined back to them.

    ``did`` is the id, or for a null id a number above all ordinary ids made from the text;
    ``tk`` is a hash of the text. Exactly repeated rows share both and get the same result.
    """
    tk = F.xxhash64(F.col(text_col).cast("string"), F.col(text_col).isNull())
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(tk, F.lit(1 << 61)))
    return [did.alias("did"), tk.alias("tk")]
