"""Working tables in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder of the application's own in ``spark.checkpoint.dir``, which goes when the application ends.

    Only a local session may do without that setting; it gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("marginalia.scratch.dir", None)
    if not folder:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("marginalia.scratch.dir", folder)
    own = f"{folder.rstrip('/')}/marginalia-{spark.sparkContext.applicationId}"
    if spark.conf.get("marginalia.scratch.own", None) != own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.conf.set("marginalia.scratch.own", own)
    return own


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder (with the writer's ``options``) and read back: its rows are fixed from then on."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffles, however small it is taken for. A table that grows with a vault is never broadcast:
    the driver would hold each, 16 MB at least, for as long as the plan lives."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the session has cores; a frame that has them already stays as it is.

    For heavy work on each row: a small file is a single task otherwise.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
