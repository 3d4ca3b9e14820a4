"""Chain of custody: file hash (H1), element hash (H2) and ordered fold (H3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.schema import CANON_VERSION


def h2(raw: Column) -> Column:
    return F.sha2(raw, 256)


def chain_column(ordered: Column, before: str = "") -> Column:
    """Fold of an array of H2 in its order: each link hashes the link before it, a
    line feed and the next H2. An empty array leaves what was before."""
    return F.aggregate(ordered, F.lit(before), lambda link, next_: F.sha2(F.concat(link, F.lit("\n"), next_).cast("binary"), 256))


def chain(records: DataFrame, key: str = "file", ordinal: str = "ordinal", h: str = "content_hash") -> DataFrame:
    """(key, record_count, chain_hash). A fold has one order, so each key is folded by
    one task; its rows are streamed sorted and not gathered, so a key of any size
    takes constant memory."""
    dealt = records.select(F.col(key).cast("string").alias("key"), F.col(ordinal).alias("ordinal"), F.col(h).alias("h2")).repartition("key").sortWithinPartitions("key", "ordinal")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, link = None, 0, ""
        for batch in batches:
            out = []
            for k, h2_ in zip(batch["key"], batch["h2"], strict=True):
                if k != now:
                    if n:
                        out.append((now, n, link))
                    now, n, link = k, 0, ""
                link = hashlib.sha256(f"{link}\n{h2_}".encode()).hexdigest()
                n += 1
            yield pd.DataFrame(out, columns=["key", "record_count", "chain_hash"])
        if n:
            yield pd.DataFrame([(now, n, link)], columns=["key", "record_count", "chain_hash"])

    return dealt.mapInPandas(fold, "key string, record_count long, chain_hash string").withColumnRenamed("key", key)


def import_rows(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row of IMPORTS (id and time aside) for each file: its H1 and the H3 of its records."""
    out = hashes.join(chain(records), "file", "left")
    return out.select("file", "file_hash", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("chain_hash", F.lit("")).alias("chain_hash"), F.lit(CANON_VERSION).alias("canon_version"))


def latest(imports: DataFrame) -> DataFrame:
    return imports.orderBy(F.desc("id")).limit(1)


def by_id(imports: DataFrame, number: int) -> DataFrame:
    return imports.filter(F.col("id") == number)


def newest_first(imports: DataFrame) -> DataFrame:
    return imports.orderBy(F.desc("id"))
