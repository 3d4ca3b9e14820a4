"""Exports of the whole table: JSON, and CSV with the columns that are in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.reads import is_call, is_message

ALWAYS = ["id", "address", "body", "type", "date", "read", "thread_id"]
IF_SET = [
    "subject", "media_type", "protocol", "status", "service_center", "sub_id", "contact_name", "sender", "content_type",
    "read_report", "read_status", "message_id", "message_size", "message_type", "sim_slot", "addresses", "content_hash",
]


def _is_set(name: str, kind: str) -> Column:
    """Whether a value is there and not its type's zero."""
    c = F.col(name)
    test = F.size(c) > 0 if kind.startswith("array") else c != "" if kind == "string" else c if kind == "boolean" else c != 0
    return F.coalesce(test, F.lit(False))


def split(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, calls)."""
    return messages.filter(is_message()), messages.filter(is_call())


def columns_in_use(messages: DataFrame) -> DataFrame:
    """(name) of the columns that an export has: some always, others if any row sets them."""
    kinds = dict(messages.dtypes)
    optional = [c for c in IF_SET if c in kinds]
    one = messages.agg(F.count("*").alias("n"), *[F.max(_is_set(c, kinds[c])).alias(c) for c in optional])
    names = F.array(*[F.when(F.col("n") > 0, F.lit(c)) for c in ALWAYS], *[F.when(F.col(c), F.lit(c)) for c in optional])
    return one.select(F.explode(F.array_sort(F.filter(names, lambda x: x.isNotNull()))).alias("name"))


def cell(name: str, kind: str) -> Column:
    """A CSV cell: strings as they are, unset optional values empty, others as JSON."""
    c = F.col(name)
    text = c if kind == "string" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
    if name in ALWAYS:
        return F.coalesce(text, F.lit(""))
    return F.when(_is_set(name, kind), text).otherwise("")


def csv_rows(messages: DataFrame) -> DataFrame:
    """Rows of text cells under a sorted header; write with header and quoting."""
    kinds = dict(messages.dtypes)
    names = [r["name"] for r in columns_in_use(messages).collect()]  # at most 24
    return messages.orderBy("date", "id").select(*[cell(n, kinds[n]).alias(n) for n in names])


def write_csv(messages: DataFrame, path: str) -> None:
    csv_rows(messages).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def json_rows(messages: DataFrame) -> DataFrame:
    """(kind, json) of every message and call, unset optional fields left out."""
    kinds = dict(messages.dtypes)
    fields = [F.col(c) if c in ALWAYS else F.when(_is_set(c, kinds[c]), F.col(c)).alias(c) for c in ALWAYS + IF_SET if c in kinds]
    calls = [F.col("id"), F.col("address").alias("number"), F.col("duration"), F.col("date"), F.col("type"), *[F.when(_is_set(c, kinds[c]), F.col(c)).alias(c) for c in ("presentation", "subscription_id", "contact_name", "content_hash") if c in kinds]]
    return messages.select(F.when(is_call(), "call").otherwise("message").alias("kind"), F.when(is_call(), F.to_json(F.struct(*calls))).otherwise(F.to_json(F.struct(*fields))).alias("json"))


def summary(messages: DataFrame, imports: DataFrame) -> DataFrame:
    """Counts of both kinds and the custody of the latest import."""
    latest = imports.orderBy(F.desc("id")).limit(1).select(F.struct("file_hash", "record_count", "chain_hash", "canon_version").alias("custody"))
    counts = messages.agg(F.count_if(is_message()).alias("message_count"), F.count_if(is_call()).alias("call_count"))
    return counts.join(F.broadcast(latest.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"), "left").drop("one")
