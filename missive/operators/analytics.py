"""Summary figures of the message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.reads import between, is_call, is_message

TOP_DEFAULT, TOP_MOST, OFFSET_MOST = 10, 50, 840


def parameters(top: str | int | None = None, tz_offset: str | int | None = None) -> tuple[int, int]:
    """Valid (top, tz_offset); what is missing, no number or out of range is the default."""

    def number(x, least: int, most: int, default: int) -> int:
        try:
            return n if least <= (n := int(x)) <= most else default
        except (TypeError, ValueError):
            return default

    return number(top, 1, TOP_MOST, TOP_DEFAULT), number(tz_offset, -OFFSET_MOST, OFFSET_MOST, 0)


def _count(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def summary(messages: DataFrame) -> DataFrame:
    """One row of totals; of an empty table all are zero."""
    kind, type_ = F.col("record_type"), F.col("type")
    return messages.agg(
        F.count("*").alias("total_messages"),
        _count(kind == 1, "total_sms"),
        _count(kind == 2, "total_mms"),
        _count(kind == 3, "total_calls"),
        _count(is_message() & (type_ == 2), "total_sent"),
        _count(is_message() & (type_ == 1), "total_received"),
        _count(is_call() & (type_ == 1), "incoming_calls"),
        _count(is_call() & (type_ == 2), "outgoing_calls"),
        _count(is_call() & (type_ == 3), "missed_calls"),
        F.coalesce(F.sum(F.when(is_call(), F.col("duration"))), F.lit(0)).cast("bigint").alias("total_call_duration"),
        F.coalesce(F.avg(F.when(is_message() & (F.col("body") != ""), F.length("body"))), F.lit(0.0)).alias("avg_message_length"),
    )


def top_contacts(messages: DataFrame, top: int = TOP_DEFAULT) -> DataFrame:
    """Addresses with the most messages; ties by address."""
    rows = messages.filter(is_message()).groupBy("address")
    found = rows.agg(F.max(F.coalesce("contact_name", F.lit(""))).alias("contact_name"), F.count("*").alias("message_count"), _count(F.col("type") == 2, "sent_count"), _count(F.col("type") == 1, "received_count"))
    return found.orderBy(F.desc("message_count"), "address").limit(top)


def hourly(messages: DataFrame, tz_offset: int = 0) -> DataFrame:
    """Messages for each of the 24 hours, shifted by minutes; hours without any are 0."""
    hour = F.pmod(F.floor((F.col("date") + tz_offset * 60) / 3600), F.lit(24)).cast("int")
    counted = messages.filter(is_message()).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    every = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return every.join(F.broadcast(counted), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("count")).orderBy("hour")


def daily(messages: DataFrame, zone: str = "UTC") -> DataFrame:
    """Messages for each day of a time zone that has any."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("date"), zone), "yyyy-MM-dd")
    return messages.filter(is_message()).groupBy(day.alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def pie_slices(totals: DataFrame) -> DataFrame:
    """Shares of message directions and call types that are not zero."""
    names = {"total_sent": ("messages", "Sent"), "total_received": ("messages", "Received"), "incoming_calls": ("calls", "Incoming"), "outgoing_calls": ("calls", "Outgoing"), "missed_calls": ("calls", "Missed")}
    rows = F.array(*[F.struct(F.lit(chart).alias("chart"), F.lit(name).alias("name"), F.col(c).alias("value")) for c, (chart, name) in names.items()])
    return totals.select(F.inline(rows)).filter("value > 0")


#: Which of (address, hour, day) a row of `figures` sums over, as grouping_id() tells it.
_TOTAL, _ADDRESS, _HOUR, _DAY = 0b111, 0b011, 0b101, 0b110
_TOTALS = ["total_messages", "total_sms", "total_mms", "total_calls", "total_sent", "total_received", "incoming_calls", "outgoing_calls", "missed_calls", "total_call_duration"]


def figures(rows: DataFrame, tz_offset: int = 0, zone: str = "UTC") -> DataFrame:
    """Totals, and the same by address, by shifted hour and by day, in one aggregation over
    grouping sets. Bodies give their lengths before rows are multiplied, and each task sums
    up its own groups before anything is shuffled."""
    hour = F.pmod(F.floor((F.col("date") + tz_offset * 60) / 3600), F.lit(24)).cast("int")
    day = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("date"), zone), "yyyy-MM-dd")
    narrow = rows.select("record_type", "type", "duration", "address", F.coalesce("contact_name", F.lit("")).alias("contact_name"), F.when(F.col("body") != "", F.length("body")).alias("chars"), hour.alias("hour"), day.alias("day"))
    by = [F.col(c) for c in ("address", "hour", "day")]
    kind, type_ = F.col("record_type"), F.col("type")
    return narrow.groupingSets([[], *[[c] for c in by]], *by).agg(
        F.grouping_id().alias("over"),
        F.count("*").alias("total_messages"),
        _count(kind == 1, "total_sms"),
        _count(kind == 2, "total_mms"),
        _count(kind == 3, "total_calls"),
        _count(is_message() & (type_ == 2), "total_sent"),
        _count(is_message() & (type_ == 1), "total_received"),
        _count(is_call() & (type_ == 1), "incoming_calls"),
        _count(is_call() & (type_ == 2), "outgoing_calls"),
        _count(is_call() & (type_ == 3), "missed_calls"),
        F.coalesce(F.sum(F.when(is_call(), F.col("duration"))), F.lit(0)).cast("bigint").alias("total_call_duration"),
        F.coalesce(F.avg(F.when(is_message(), F.col("chars"))), F.lit(0.0)).alias("avg_message_length"),
        F.max(F.when(is_message(), F.col("contact_name"))).alias("contact_name"),
        _count(is_message(), "message_count"),
    )


def analytics(messages: DataFrame, start: int | None = None, end: int | None = None, top: int = TOP_DEFAULT, tz_offset: int = 0, zone: str = "UTC") -> dict[str, DataFrame]:
    """All figures under one date filter, from one scan: the sums, a row for each address,
    hour and day, are held as `figures`, for the caller to unpersist."""
    held = figures(between(messages, start, end), tz_offset, zone).persist()
    spark, talks = messages.sparkSession, held.filter("message_count > 0")
    none = spark.range(1).select(F.lit(_TOTAL).cast("bigint").alias("over"))  # an empty table has no groups, but totals
    whole = none.join(held.filter(F.col("over") == _TOTAL), "over", "left")
    hours = talks.filter(F.col("over") == _HOUR).select("hour", F.col("message_count").alias("count"))
    every = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    contacts = talks.filter(F.col("over") == _ADDRESS).select("address", "contact_name", "message_count", F.col("total_sent").alias("sent_count"), F.col("total_received").alias("received_count"))
    return {
        "summary": whole.select(*[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _TOTALS], F.coalesce("avg_message_length", F.lit(0.0)).alias("avg_message_length")),
        "top_contacts": contacts.orderBy(F.desc("message_count"), "address").limit(top),
        "hourly": every.join(F.broadcast(hours), "hour", "left").select("hour", F.coalesce("count", F.lit(0).cast("bigint")).alias("count")).orderBy("hour"),
        "daily": talks.filter(F.col("over") == _DAY).select("day", F.col("message_count").alias("count")).orderBy("day"),
        "figures": held,
    }
