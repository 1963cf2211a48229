"""Salted key verification, masks, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Fixed value: days that a settings session lasts, in seconds.
SESSION_SECONDS = 604_800


def salted(salt: Column, key: Column) -> Column:
    """``sha256$salt$digest`` of a key."""
    return F.concat_ws("$", F.lit("sha256"), salt, F.sha2(F.concat(salt, F.lit(":"), key).cast("binary"), 256))


def verifies(stored: Column, key: Column) -> Column:
    """Whether a key is the one that a stored hash was made of; false for malformed hashes."""
    parts = F.split(stored, r"\$")
    return F.coalesce((F.size(parts) == 3) & (stored == salted(F.get(parts, F.lit(1)), key)), F.lit(False))


def open_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now)


def expiry(now: Column) -> Column:
    return now + F.make_interval(secs=F.lit(SESSION_SECONDS))


def resolved_settings(stored: DataFrame, defaults: DataFrame, clearable: str = "embedding_api_key") -> DataFrame:
    """(setting_key, setting_value): stored settings over defaults. Blank ones are ignored, except that
    the ``clearable`` one may be set to nothing."""
    given = trimmed(F.col("stored"))
    mine = stored.select("setting_key", F.col("setting_value").alias("stored"))
    both = mine.join(defaults.select("setting_key", F.col("setting_value").alias("default")), "setting_key", "full")
    value = F.when((given != "") | (F.col("stored").isNotNull() & (F.col("setting_key") == clearable)), given).otherwise(F.col("default"))
    return both.select("setting_key", value.alias("setting_value"))
