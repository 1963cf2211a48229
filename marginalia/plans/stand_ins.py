"""The engine's tables as they stand in for by the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base64_of
from ..schema import GENERATED_DEVICE


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "embeddings")
    kind = F.when(F.col("vec_id") % 3 == 0, "usercreated").when(F.col("vec_id") % 3 == 1, "aicreated").otherwise("imported")
    return t.select(F.col("vec_id").alias("id"), F.concat(F.lit("atom "), F.col("vec_id")).alias("content"), F.col("embedding").alias("vector"), kind.alias("type"), F.lit(None).cast("string").alias("metadata"))


def files(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("id")).distinct()
    suffix = F.when(F.col("id") % 3 == 0, ".MD").when(F.col("id") % 3 == 1, ".md").otherwise(".txt")
    return ids.select(
        "id", (F.col("id") % 4).alias("vault_id"), F.concat(F.lit("notes/"), "id", suffix).alias("file_path"), F.when(F.col("id") % 5 == 0, " ").otherwise(F.concat(F.lit(" File "), "id")).alias("subject"),
        (F.col("id") % 10 == 9).alias("is_deleted"), (F.col("id") * 1000).alias("updated_unix_ms"))


def file_atoms(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "embeddings")
    return t.select((F.col("vec_id") % 100).alias("file_id"), F.col("vec_id").alias("atom_id"))


def source_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Each label's vectors, and links to atoms that don't exist."""
    t = load(spark, d, "embeddings").select(F.col("label").cast("long").alias("source_id"), F.col("vec_id").alias("atom_id"))
    return t.union(t.filter("atom_id < 25").select("source_id", F.col("atom_id") + 1_000_000_000))


def log(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "events")
    body = F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).cast("binary")
    action = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return t.select(
        ((F.col("event_id") * 7919) % 1000003).alias("id"), (F.col("user_id") % 7).alias("vault_id"), F.concat("user_id", F.lit("/"), F.col("event_id") % 5, F.lit(".md")).alias("file_path"),
        action.alias("action"), ms.alias("changed_at_unix_ms"), base64_of(body).alias("content_base64"), F.sha2(body, 256).alias("content_sha256"), F.octet_length(body).cast("long").alias("size_bytes"),
        F.when(F.col("event_id") % 11 == 0, GENERATED_DEVICE).otherwise("phone").alias("device_id"))


def note_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of short notes, two in three events older (ids below a thousand million), the others a later push.

    Notes on one type of event differ in a number at their end, so that they are near each other.
    """
    t = load(spark, d, "events")
    later = F.when(F.col("event_id") % 3 == 2, 1_000_000_000).otherwise(0)
    kind = F.initcap("event_type")
    entry = F.concat(F.lit("Log of the week for the regions and their teams, entry "), F.lpad((F.col("user_id") % 40).cast("string"), 2, "0"))
    body = F.concat(F.lit("# "), kind, F.lit("\n\n- "), entry).cast("binary")
    suffix = F.when(F.col("event_id") % 5 == 4, ".txt").otherwise(".md")
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    gone = F.col("event_type") == "error"
    return t.select(
        (later + F.col("event_id") + 1).alias("id"), (F.col("user_id") % 3).alias("vault_id"), F.concat(F.lit("n/"), "user_id", F.lit("-"), F.col("event_id") % 5, suffix).alias("file_path"),
        F.when(gone, "deleted").otherwise("modified").alias("action"), ms.alias("changed_at_unix_ms"), F.when(gone, "").otherwise(base64_of(body)).alias("content_base64"),
        F.when(gone, "").otherwise(F.sha2(body, 256)).alias("content_sha256"), F.when(gone, 0).otherwise(F.octet_length(body)).cast("long").alias("size_bytes"), F.lit("phone").alias("device_id"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


ATOMS = "atoms AS (SELECT vec_id AS id, 'atom ' || vec_id AS content, embedding::DOUBLE[] AS vector, CASE vec_id % 3 WHEN 0 THEN 'usercreated' WHEN 1 THEN 'aicreated' ELSE 'imported' END AS type, NULL::VARCHAR AS metadata FROM embeddings)"
FILES = (
    "files AS (SELECT id, id % 4 AS vault_id, 'notes/' || id || CASE id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.md' ELSE '.txt' END AS file_path,"
    " CASE WHEN id % 5 = 0 THEN ' ' ELSE ' File ' || id END AS subject, id % 10 = 9 AS is_deleted, id * 1000 AS updated_unix_ms FROM (SELECT DISTINCT vec_id % 100 AS id FROM embeddings))"
)
FILE_ATOMS = "file_atoms AS (SELECT vec_id % 100 AS file_id, vec_id AS atom_id FROM embeddings)"
SOURCE_ATOMS = (
    "source_atoms AS (SELECT label::BIGINT AS source_id, vec_id AS atom_id FROM embeddings UNION ALL SELECT label::BIGINT, vec_id + 1000000000 FROM embeddings WHERE vec_id < 25)"
)
LOG = (
    "log AS (SELECT (event_id * 7919) % 1000003 AS id, user_id % 7 AS vault_id, user_id || '/' || (event_id % 5) || '.md' AS file_path,"
    " CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS action, epoch_us(ts) // 1000 AS changed_at_unix_ms,"
    " base64(encode(event_type || ' ' || coalesce(props, ''))) AS content_base64, sha256(event_type || ' ' || coalesce(props, '')) AS content_sha256,"
    " strlen(event_type || ' ' || coalesce(props, ''))::BIGINT AS size_bytes, CASE WHEN event_id % 11 = 0 THEN 'generated' ELSE 'phone' END AS device_id FROM events)"
)
NOTE_LOG = (
    "nlog AS (SELECT CASE WHEN event_id % 3 = 2 THEN 1000000000 ELSE 0 END + event_id + 1 AS id, event_id % 3 = 2 AS later, user_id % 3 AS vault_id,"
    " 'n/' || user_id || '-' || (event_id % 5) || CASE WHEN event_id % 5 = 4 THEN '.txt' ELSE '.md' END AS file_path, event_type = 'error' AS gone, upper(event_type[1]) || event_type[2:] AS kind,"
    " lpad((user_id % 40)::VARCHAR, 2, '0') AS entry FROM events)"
)
STATE = (
    "state AS (SELECT vault_id, file_path, CASE WHEN a = 'deleted' THEN '' ELSE b END AS base64, CASE WHEN a = 'deleted' THEN '' ELSE s END AS content_sha256,"
    " CASE WHEN a = 'deleted' THEN 0 ELSE n END::BIGINT AS size_bytes, a = 'deleted' AS is_deleted, t AS updated_unix_ms, v AS content_version, id AS last_change_id FROM"
    " (SELECT vault_id, file_path, arg_max(action, id) AS a, arg_max(content_base64, id) AS b, arg_max(content_sha256, id) AS s, arg_max(size_bytes, id) AS n,"
    " arg_max(changed_at_unix_ms, id) AS t, count(*) FILTER (device_id <> 'generated') AS v, max(id) AS id FROM log GROUP BY ALL))"
)
CENTROIDS = (
    "terms AS (SELECT source_id, pos, avg(x) AS mean, count(*) AS n FROM (SELECT s.source_id, unnest(range(1, len(vector) + 1)) AS pos, unnest(vector) AS x"
    " FROM source_atoms s JOIN atoms a ON a.id = s.atom_id) GROUP BY ALL),"
    " indexes AS (SELECT source_id, list(mean ORDER BY pos) AS embedding, max(n)::INT AS atom_count FROM terms GROUP BY 1)"
)
