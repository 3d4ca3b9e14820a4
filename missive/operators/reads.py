"""Reads of the message table: lists, threads, calls, media, pages."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions import labels, mime
from missive.schema import CALL

DEFAULT_PAGE = 50
DEFAULT_THREAD = 100_000
_RFC3339 = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})")


def instant(text: str | None) -> int | None:
    """Epoch seconds of an RFC 3339 time; anything else is no bound at all."""
    if not _RFC3339.fullmatch(text or ""):
        return None
    try:
        return int(datetime.fromisoformat(text).timestamp() // 1)
    except ValueError:  # no such day or hour
        return None


def between(messages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows within both bounds, which are inclusive and each optional."""
    if start is not None:
        messages = messages.filter(F.col("date") >= start)
    if end is not None:
        messages = messages.filter(F.col("date") <= end)
    return messages


def of_address(messages: DataFrame, address: str | None) -> DataFrame:
    """Rows of an address; an empty one does not filter."""
    return messages.filter(F.col("address") == address) if address else messages


def is_message() -> Column:
    return F.col("record_type").isin(1, 2)


def is_call() -> Column:
    return F.col("record_type") == CALL


def filled(messages: DataFrame) -> DataFrame:
    """Nulls of the optional columns as their zero values."""
    zero = {"string": "", "bigint": 0, "int": 0, "boolean": False}
    return messages.select(*[F.coalesce(c, F.lit(zero[t]).cast(t)).alias(c) if t in zero and c != "id" else F.col(c) for c, t in messages.dtypes])


def conversations(messages: DataFrame, start: int | None = None, end: int | None = None, dedupe: bool = False) -> DataFrame:
    """A row for each address, newest first; addresses with several rows at their
    last second have one for each of these, unless dedupe keeps the least id.

    Two passes over one shuffle by address: aggregates, and the rows at the maximum.
    The aggregate is combined before the shuffle, so a hot address costs one row a task.
    """
    rows = between(messages, start, end)
    total = rows.groupBy("address").agg(
        F.max(F.coalesce("contact_name", F.lit(""))).alias("contact_name"),
        F.coalesce(F.max(F.when(F.col("subject") != "", F.col("subject"))), F.lit("")).alias("subject"),
        F.max("date").alias("last_date"),
        F.count("*").alias("message_count"),
    )
    text = F.coalesce(F.when(is_call(), labels.call(F.col("type"), None)), F.col("body"), F.lit(""))
    last = rows.select("id", "address", F.col("date").alias("last_date"), text.alias("last_message"))
    found = total.join(last, ["address", "last_date"])
    if dedupe:
        found = found.withColumn("n", F.row_number().over(W.partitionBy("address").orderBy("id"))).filter("n = 1")
    return found.select("address", "contact_name", "subject", "last_message", "last_date", "message_count").orderBy(F.desc("last_date"), "address", "last_message")


def conversations_window(messages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The same rows by one window and no join: best where no address is hot."""
    own = W.partitionBy("address")
    text = F.coalesce(F.when(is_call(), labels.call(F.col("type"), None)), F.col("body"), F.lit(""))
    rows = between(messages, start, end).select(
        "address",
        "date",
        F.max(F.coalesce("contact_name", F.lit(""))).over(own).alias("contact_name"),
        F.coalesce(F.max(F.when(F.col("subject") != "", F.col("subject"))).over(own), F.lit("")).alias("subject"),
        text.alias("last_message"),
        F.max("date").over(own).alias("last_date"),
        F.count("*").over(own).alias("message_count"),
    )
    found = rows.filter("date = last_date").drop("date")
    return found.select("address", "contact_name", "subject", "last_message", "last_date", "message_count")


def matching(found: DataFrame, text: str) -> DataFrame:
    """Conversations whose name or address holds the text, in any case."""
    low = text.lower()
    return found.filter(F.lower("contact_name").contains(low) | F.lower("address").contains(low))


def thread_messages(messages: DataFrame, address: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(messages.filter((F.col("address") == address) & is_message()), start, end).orderBy("date", "id")


def thread_calls(messages: DataFrame, number: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(messages.filter((F.col("address") == number) & is_call()), start, end).orderBy("date", "id")


def page(ordered: DataFrame, limit: int | None = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """Rows after an offset; a negative limit is none."""
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered if limit is None or limit < 0 else ordered.limit(limit)


def activity(messages: DataFrame, address: str | None = None, start: int | None = None, end: int | None = None, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """Messages and calls by time, as a tagged union: kind, and the fields of one side."""
    rows = page(between(of_address(messages, address), start, end).orderBy("date", "id"), limit, offset)
    message = F.struct("id", "address", "body", "type", "date", "subject", "contact_name")
    call = F.struct("id", F.col("address").alias("number"), "duration", "date", "type", "contact_name")
    return rows.select("id", labels.kind(F.col("record_type")).alias("kind"), "date", "address", F.coalesce("contact_name", F.lit("")).alias("contact_name"), F.when(is_message(), message).alias("message"), F.when(is_call(), call).alias("call"))


def activity_count(messages: DataFrame, address: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(of_address(messages, address), start, end).agg(F.count("*").alias("total"))


def calls(messages: DataFrame, start: int | None = None, end: int | None = None, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    return page(between(messages.filter(is_call()), start, end).orderBy("date", "id"), limit, offset)


def thread(messages: DataFrame, address: str, limit: int | None = None, offset: int = 0, show_calls: bool = True, setting: int = DEFAULT_THREAD) -> tuple[DataFrame, DataFrame]:
    """(items, total) of a mixed thread. The page is cut first and calls are hidden
    then, and total counts them still."""
    size = limit if limit and limit > 0 else setting if setting > 0 else DEFAULT_THREAD
    rows = page(of_address(messages, address).orderBy("date", "id"), size, max(0, offset))
    return (rows if show_calls else rows.filter(is_message())), activity_count(messages, address)


def last_page(messages: DataFrame, address: str, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The newest page of a thread in time order, without counting the thread first."""
    return of_address(messages, address).orderBy(F.desc("date"), F.desc("id")).limit(limit).orderBy("date", "id")


def is_last(rows_on_page: int, limit: int = DEFAULT_PAGE) -> bool:
    """A page that is not full is the last."""
    return rows_on_page < limit


def date_range(messages: DataFrame) -> DataFrame:
    """First and last date; of an empty table both are null."""
    return messages.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def media_items(messages: DataFrame, address: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Images and videos, newest first; their bytes are not read."""
    rows = between(of_address(messages.filter(is_message() & mime.is_listed_media(F.col("media_type"))), address), start, end)
    return rows.orderBy(F.desc("date"), F.desc("id"))


def media_content(messages: DataFrame, media: DataFrame, number: int) -> DataFrame:
    """Bytes and type of one message's media, and what it would need to be shown."""
    one = messages.filter((F.col("id") == number) & is_message()).select("id", "content_hash")
    return media.join(F.broadcast(one.limit(1)), "content_hash").select("id", "media_type", "media_data", mime.needs_conversion(F.col("media_type")).alias("needs_conversion"))


def byte_range(header: str | None, size: int) -> tuple[int, int] | None:
    """(first, last) of a bytes=a-b header, an open end being the last byte; None for
    no header. A range outside the blob is an error."""
    if not header:
        return None
    first, dash, last = header.removeprefix("bytes=").partition("-")
    if not header.startswith("bytes=") or not dash or not first.isdigit() or last and not last.isdigit():
        raise ValueError(f"bad range {header!r}")
    a, b = int(first), int(last) if last else size - 1
    if a > b or b >= size:
        raise ValueError(f"range {header!r} is outside {size} bytes")
    return a, b


def slice_media(found: DataFrame, first: int, last: int) -> DataFrame:
    return found.withColumn("media_data", F.substring("media_data", first + 1, last - first + 1))


def first_names(items: DataFrame) -> DataFrame:
    """First contact name and subject of a thread in time order that are not empty,
    and how many items have media."""
    at = F.struct("date", "id")
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", at))
    return items.agg(first("contact_name").alias("contact_name"), first("subject").alias("subject"), F.count_if(F.coalesce(F.col("media_type") != "", F.lit(False))).alias("media_count"))
