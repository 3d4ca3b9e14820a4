"""Messages as a view of the `events` table, for the oracle queries.

The SQL and DataFrame forms say the same; see `messages` and MESSAGES_SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MEDIA = ["image/jpeg", "VIDEO/mp4", "audio/amr", "text/x-vcard", ""]

MESSAGES_SQL = """
SELECT event_id AS id,
  CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END AS INTEGER) AS record_type,
  concat('+1', lpad(CAST(user_id AS VARCHAR), 10, '0')) AS address,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Contact ', user_id) END AS contact_name,
  CASE WHEN event_type = 'signup' THEN concat('Subject ', user_id % 7) ELSE '' END AS subject,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS body,
  CAST(event_id % 6 + 1 AS BIGINT) AS type,
  CAST(floor(epoch(ts)) AS BIGINT) AS date,
  CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) END AS duration,
  CASE event_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'VIDEO/mp4' WHEN 2 THEN 'audio/amr' WHEN 3 THEN 'text/x-vcard' ELSE '' END AS media_type,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'application/vnd.wap.multipart.related' ELSE '' END AS content_type,
  '' AS message_id,
  event_id % 2 = 0 AS read,
  user_id % 50 AS thread_id
FROM events
"""
#: Dates cut to days, so that many rows share a last second.
DAYS_SQL = f"SELECT * REPLACE (date - date % 86400 AS date) FROM ({MESSAGES_SQL})"


def _or_null(test: Column, value: Column) -> Column:
    return F.when(test, value)


def messages(spark: SparkSession, sf_dir: str, days: bool = False) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    date = F.unix_timestamp(F.col("ts").cast("timestamp"))
    media = F.get(F.array(*[F.lit(m) for m in _MEDIA]), n % 5)
    return e.select(
        n.alias("id"),
        F.when(kind.isin("click", "view"), 1).when(kind.isin("purchase", "signup"), 2).otherwise(3).alias("record_type"),
        F.concat(F.lit("+1"), F.lpad(user.cast("string"), 10, "0")).alias("address"),
        _or_null(n % 4 != 0, F.concat(F.lit("Contact "), user.cast("string"))).alias("contact_name"),
        F.when(kind == "signup", F.concat(F.lit("Subject "), (user % 7).cast("string"))).otherwise("").alias("subject"),
        _or_null(kind != "error", F.col("props")).alias("body"),
        (n % 6 + 1).alias("type"),
        (date - date % 86400 if days else date).alias("date"),
        _or_null(kind == "error", F.floor("value").cast("bigint")).alias("duration"),
        media.alias("media_type"),
        F.when(kind.isin("purchase", "signup"), "application/vnd.wap.multipart.related").otherwise("").alias("content_type"),
        F.lit("").alias("message_id"),
        (n % 2 == 0).alias("read"),
        (user % 50).alias("thread_id"),
    )
