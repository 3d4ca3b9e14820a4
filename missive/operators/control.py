"""Control tables: sessions, users and settings. Secrets stay outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"show_calls": True, "message_limit": 100_000}


def valid_sessions(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Sessions that have not ended, with their users' names."""
    return sessions.filter(F.col("expires_at") >= now).join(users.select("user_id", "username"), "user_id")


def expired_sessions(sessions: DataFrame, now: int) -> DataFrame:
    return sessions.filter(F.col("expires_at") < now)


def user_list(users: DataFrame) -> DataFrame:
    return users.orderBy("username")


def settings_latest(changes: DataFrame, key: str = "user_id", value: str = "settings", at: str = "updated_at") -> DataFrame:
    """The last written value of each key."""
    return changes.groupBy(key).agg(F.max_by(value, at).alias(value))


def settings_of(text: str | None) -> dict:
    """Settings from their JSON; what is missing has its default."""
    import json

    return DEFAULTS | (json.loads(text) if text else {})
