"""Files that are still being written when they are first seen.

The drop directory is looked at again and again; each look is a small file of sightings
(path, size, time). A stream over the sightings keeps a state for each path: what it
looked like, since when, and whether it was released. A file is released for import when
two looks, `quiet` seconds apart at least, found it the same, and again only if it looks
different afterwards: one that failed stays where it is and is taken up once it is
mended. A path that is not seen for a while is forgotten.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from missive.operators.store import Store
from missive.session import Files
from missive.sources import ranges

SIGHTINGS = "path string, size long, modified timestamp, seen double"
STATE = "size long, modified double, since double, released boolean"
RELEASED = "path string, size long, seen double"
QUIET = 5.0
#: Milliseconds without a sighting after which a path is forgotten.
FORGET = 3_600_000


def look(spark: SparkSession, inbox: str, sightings: str, now: float | None = None) -> None:
    """Note what the XML files of a directory look like just now; none of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", ranges.NAMES).load(inbox).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    draft = f"{sightings}/.{uuid.uuid4().hex}"
    found.withColumn("seen", F.lit(time.time() if now is None else float(now))).coalesce(1).write.parquet(draft)
    files = Files(spark)
    for name in files.names(draft):
        if name.endswith(".parquet"):
            files.move(f"{draft}/{name}", sightings)
    files.remove(draft)


def settled(spark: SparkSession, sightings: str, quiet: float = QUIET) -> DataFrame:
    """Stream of RELEASED files."""

    def judge(key: tuple, sightings: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        size, modified, since, released = state.get if state.exists else (None, None, 0.0, False)
        for r in pd.concat(list(sightings)).sort_values("seen").itertuples():
            when = r.modified.timestamp()
            if (r.size, when) != (size, modified):
                size, modified, since, released = int(r.size), when, float(r.seen), False
            elif not released and r.seen - since >= quiet:
                released = True
                out.append((key[0], size, float(r.seen)))
        state.update((size, modified, since, released))
        state.setTimeoutDuration(FORGET)
        yield pd.DataFrame(out, columns=["path", "size", "seen"])

    own = spark.newSession()
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a timeout keeps a run over what is there from ending
    seen = own.readStream.schema(SIGHTINGS).parquet(sightings)
    return seen.groupBy("path").applyInPandasWithState(judge, RELEASED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(spark: SparkSession, sightings: str, store: Store, checkpoint: str, archive: str, quiet: float = QUIET, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Import files as they settle: whole ones move to the archive, failed ones stay."""

    def batch(released: DataFrame, number: int) -> None:
        files = Files(spark)
        paths = [r["path"] for r in released.select("path").distinct().collect()]  # of one batch of looks
        paths = [p for p in paths if files.exists(p)]
        if not paths:
            return
        done = store.append(ranges.pieces(spark, paths), checkpoint, number)
        for r in done.filter("status = 'completed'").select("file").collect():
            files.move(r["file"], archive)

    writer = settled(spark, sightings, quiet).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def watch(spark: SparkSession, inbox: str, sightings: str, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Look at a directory at every tick."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, __: look(spark, inbox, sightings)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()

