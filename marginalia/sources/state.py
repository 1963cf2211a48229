"""What sync clients save between runs, one JSON text each, and a probe of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a saved state.
STATE = (
    "vault_uid string, last_server_change_id bigint, last_server_change_unix_ms bigint,"
    " local_snapshot map<string, struct<size_bytes: bigint, modified_unix_ms: bigint, content_fingerprint: string>>"
)


def client_states(saved: DataFrame, uid_col: str = "vault_uid", text_col: str = "state") -> DataFrame:
    """(vault_uid, last_server_change_id, last_server_change_unix_ms, local_snapshot, fresh) of each client.

    A state that is missing, broken, or another vault's counts for nothing: the client starts fresh,
    without marks and files.
    """
    rows = saved.select(F.col(uid_col).alias("uid"), F.from_json(text_col, STATE).alias("s"))
    good = F.coalesce(F.col("s.vault_uid") == F.col("uid"), F.lit(False))
    none = F.create_map().cast("map<string, struct<size_bytes: bigint, modified_unix_ms: bigint, content_fingerprint: string>>")
    return rows.select(
        F.col("uid").alias("vault_uid"), *[F.when(good, F.col(f"s.{c}")).alias(c) for c in ("last_server_change_id", "last_server_change_unix_ms")],
        F.when(good & F.col("s.local_snapshot").isNotNull(), F.col("s.local_snapshot")).otherwise(none).alias("local_snapshot"), (~good).alias("fresh"))


def state_texts(states: DataFrame) -> DataFrame:
    """(vault_uid, state): what is saved again; fields without a value are left out."""
    return states.select("vault_uid", F.to_json(F.struct("vault_uid", "last_server_change_id", "last_server_change_unix_ms", "local_snapshot")).alias("state"))


def first_table(spark: SparkSession) -> str | None:
    """The first table of the catalogue by name, as a probe that it answers."""
    return min((t.name for t in spark.catalog.listTables()), default=None)
