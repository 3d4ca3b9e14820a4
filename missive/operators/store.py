"""The stored message table: idempotent append, media side table, imports.

A store is a folder of batches. Each append writes messages, media, imports and its log
into a batch folder of its own, and then a manifest, which names the batches that are
the store from then on. The manifest is renamed into place whole, so an append that dies
before that leaves the state before, and what it wrote is no part of any read.

Rows lie in buckets of their key's hash (media: of their content hash), so an append
compares its records with the buckets that they fall into and reads no others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive import schema
from missive.operators import custody, normalize
from missive.session import Files
from missive.sources import backup, ranges
from missive.streaming.progress import Progress

BUCKETS = 64
#: Media are cut into chunks, so that a range of bytes is read from its own.
CHUNKS = "content_hash string, media_type string, size long, n int, data binary"
CHUNK = 1 << 18
FILES = "file string, status string, records long, source string, number long, logged_at timestamp"


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def key_columns() -> list[Column]:
    """The record key, nulls of its optional columns as their zero values."""
    zero = {"body": "", "content_type": "", "message_id": "", "duration": 0}
    return [F.coalesce(F.col(c), F.lit(zero[c]).cast("bigint" if c == "duration" else "string")) if c in zero else F.col(c) for c in schema.DEDUP_KEY]


def key_hash() -> Column:
    """128 bits of the key: what is shuffled for deduplication instead of bodies."""
    return F.md5(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in key_columns()])))


def bucket(hash_: Column) -> Column:
    """The bucket of a hash in hexadecimal."""
    return (F.conv(F.substring(hash_, 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def first_wins(records: DataFrame, order: list[str]) -> DataFrame:
    """One record for each key, the first by `order`."""
    keyed = records.withColumn("key_hash", key_hash())
    ranked = keyed.withColumn("n", F.row_number().over(W.partitionBy("key_hash").orderBy(*order)))
    return ranked.filter("n = 1").drop("n")


def unseen(records: DataFrame, stored: DataFrame, key: str = "key_hash") -> DataFrame:
    """Records whose key the store does not have; both sides carry it."""
    return records.join(stored.select(key).distinct(), key, "left_anti")


_MESSAGES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.MESSAGES) + ", key_hash string, bucket int"
_TABLES = {name: f"{ddl}, batch string" for name, ddl in {"messages": _MESSAGES, "media": f"{CHUNKS}, bucket int", "imports": schema.IMPORTS, "files": FILES}.items()}


class Store:
    """A folder with messages, media, imports and a log of files, of one tenant. Of
    several writers at once the first to commit wins; the others get a Conflict."""

    def __init__(self, spark: SparkSession, path: str, chunk: int = CHUNK):
        self.spark, self.path, self.chunk, self.files_ = spark, path.rstrip("/"), chunk, Files(spark)

    # -------------------------------------------------------- state

    def state(self) -> dict:
        """The newest manifest."""
        names = sorted(n for n in self.files_.names(f"{self.path}/manifest") if n.endswith(".json"))
        if not names:
            return {"version": 0, "batches": [], "last_id": 0, "last_import": 0, "sources": {}}
        return json.loads(self.files_.read(f"{self.path}/manifest/{names[-1]}"))

    def _commit(self, before: dict, after: dict) -> None:
        after = after | {"version": before["version"] + 1}
        if not self.files_.publish(f"{self.path}/manifest/{after['version']:012}.json", json.dumps(after)):
            raise Conflict(f"version {after['version']} of {self.path} is there already")

    def _read(self, name: str, batches: list[str] | None = None) -> DataFrame:
        ids = self.state()["batches"] if batches is None else batches
        if not ids:
            return self.spark.createDataFrame([], _TABLES[name]).drop("batch")
        home = f"{self.path}/data/{name}"
        return self.spark.read.schema(_TABLES[name]).option("basePath", home).parquet(*[f"{home}/batch={b}" for b in ids]).drop("batch")

    def _write(self, rows: DataFrame, name: str, batch: str) -> None:
        writer = rows.write
        if "bucket" in rows.columns:
            order = ["content_hash", "n"] if name == "media" else ["key_hash"]
            writer = rows.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket")
        writer.parquet(f"{self.path}/data/{name}/batch={batch}")

    def messages(self) -> DataFrame:
        return self._read("messages").drop("key_hash", "bucket")

    def chunks(self) -> DataFrame:
        return self._read("media").drop("bucket")

    def media(self) -> DataFrame:
        """Whole blobs (schema.MEDIA)."""
        return _joined(self.chunks())

    def media_range(self, first: int, last: int, content_hash: str | None = None) -> DataFrame:
        """Bytes first to last, both inside, of one blob or of each that has the first of them,
        from the chunks that hold them and from no others."""
        own = self._read("media").filter(F.col("n").between(first // self.chunk, last // self.chunk) & (F.col("size") > first))
        if content_hash is not None:
            own = own.filter((F.col("bucket") == int(content_hash[:4], 16) % BUCKETS) & (F.col("content_hash") == content_hash))
        return _joined(own).withColumn("media_data", F.substring("media_data", first % self.chunk + 1, last - first + 1))

    def imports(self) -> DataFrame:
        return self._read("imports")

    def files(self) -> DataFrame:
        """What became of every imported file."""
        return self._read("files")

    # -------------------------------------------------------- writes

    def append(self, found: DataFrame, source: str = "", number: int | None = None, progress: Progress | None = None) -> DataFrame:
        """Import files(path, content), or pieces of files of any size (`ranges.PIECES`):
        what is new, and a row of imports for each file without an error. Returns the log
        (FILES) of the batch.

        A duplicate counts in its file's chain and record count, but is stored once. Batch
        `number` of a source is imported once: again, its log is returned and nothing done.
        A progress follows the reading of pieces, and is exact when this returns.
        """
        before = self.state()
        last = before["sources"].get(source)
        if number is not None and last and number <= last[0]:
            return self._read("files", [last[1]]).filter((F.col("source") == source) & (F.col("number") == number))
        batch = uuid.uuid4().hex
        held: list[DataFrame] = []
        try:
            counts = self._written(found, batch, before, source, number, held, progress)
        except BaseException:
            if progress is not None:
                progress.drop()
            raise
        finally:
            for df in held:
                df.unpersist()
        sources = before["sources"] | ({source: [number, batch]} if number is not None else {})
        self._commit(before, before | {"batches": [*before["batches"], batch], "sources": sources, "last_id": before["last_id"] + counts[0], "last_import": before["last_import"] + counts[1]})
        return self._read("files", [batch])

    def _written(self, found: DataFrame, batch: str, before: dict, source: str, number: int | None, held: list[DataFrame], progress: Progress | None) -> tuple[int, int]:
        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        if "piece" in found.columns:
            elements = ranges.elements(found, keep=True, progress=progress)
            held.append(elements.scanned)
            raw, hashes = ranges.until_error(elements, held=True), hold(ranges.file_hashes(found))
        else:
            raw, hashes = hold(backup.split(found)), hold(backup.file_hashes(found))
        rows = hold(normalize.messages(raw))
        fresh = first_wins(rows, ["file", "ordinal"]).withColumn("bucket", bucket(F.col("key_hash")))
        new = unseen(fresh, self._own("messages", before, rows.select(bucket(key_hash()).alias("bucket"))))
        # ids continue in source order: a sort by ranges and each range's own count
        numbered, ordered, n = _numbered(new, ["file", "ordinal"], before["last_id"])
        held.append(ordered)
        columns = [f.name for f in schema.MESSAGES]
        self._write(numbered.select(*columns, "key_hash", "bucket"), "messages", batch)
        media = rows.filter("media_data IS NOT NULL").select("content_hash", "media_type", "media_data").dropDuplicates(["content_hash"]).withColumn("bucket", bucket(F.col("content_hash")))
        self._write(_cut(unseen(media, self._own("media", before, media.select("bucket")), "content_hash"), self.chunk), "media", batch)
        status = raw.groupBy("file").agg(F.when(F.count_if(F.col("kind") == "error") > 0, "error").otherwise("completed").alias("status"))
        status = hashes.select("file").join(status, "file", "left").select("file", F.coalesce("status", F.lit("completed")).alias("status"))
        done = custody.import_rows(rows, hashes).join(status.filter("status = 'completed'"), "file", "left_semi")
        imports, ordered, m = _numbered(done, ["file"], before["last_import"])
        held.append(ordered)
        self._write(imports.select("id", "file_hash", "record_count", "chain_hash", "canon_version", F.current_timestamp().alias("created_at")), "imports", batch)
        log = status.join(rows.groupBy("file").agg(F.count("*").alias("records")), "file", "left")
        log = log.select("file", "status", F.coalesce("records", F.lit(0)).alias("records"), F.lit(source).alias("source"), F.lit(number).cast("long").alias("number"), F.current_timestamp().alias("logged_at"))
        self._write(log, "files", batch)
        if progress is not None and "piece" in found.columns:
            progress.end()
        return n, m

    def _own(self, name: str, before: dict, buckets: DataFrame) -> DataFrame:
        """Stored rows in the buckets of a batch, of which there are BUCKETS at most."""
        own = [r["bucket"] for r in buckets.distinct().collect()] if before["batches"] else []
        return self._read(name, before["batches"]).filter(F.col("bucket").isin(own))

    def compact(self) -> None:
        """Rewrite all batches as one."""
        before = self.state()
        if len(before["batches"]) < 2:
            return
        batch = uuid.uuid4().hex
        for name in _TABLES:
            self._write(self._read(name, before["batches"]), name, batch)
        sources = {s: [n, batch] for s, (n, _) in before["sources"].items()}
        self._commit(before, before | {"batches": [batch], "sources": sources})

    def vacuum(self) -> list[str]:
        """Remove batches that the newest manifest does not name: those of appends that
        died, and those that were compacted. Not while someone writes, or reads of old."""
        kept, gone = set(self.state()["batches"]), set()
        for name in _TABLES:
            for folder in self.files_.names(f"{self.path}/data/{name}"):
                if (batch := folder.removeprefix("batch=")) not in kept:
                    self.files_.remove(f"{self.path}/data/{name}/{folder}")
                    gone.add(batch)
        return sorted(gone)


def _cut(media: DataFrame, chunk: int) -> DataFrame:
    size = F.octet_length("media_data")
    last = F.greatest(F.floor((size - 1) / chunk), F.lit(0)).cast("int")
    each = media.select("content_hash", "media_type", "media_data", "bucket", size.cast("long").alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("n"))
    return each.select("content_hash", "media_type", "size", "n", F.substring("media_data", F.col("n") * chunk + 1, F.lit(chunk)).alias("data"), "bucket")


def _joined(chunks: DataFrame) -> DataFrame:
    parts = chunks.groupBy("content_hash").agg(F.first("media_type").alias("media_type"), F.array_sort(F.collect_list(F.struct("n", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["data"]))
    return parts.select("content_hash", "media_type", whole.alias("media_data"))


def _numbered(rows: DataFrame, order: list[str], after: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with consecutive ids in an order, without bringing them into one task; the
    held table that they are read from, for the caller to let go; and their number."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).persist()
    shifts, total = [], after
    for r in ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect():
        shifts.append((r["part"], total - r["first"] + 1))
        total += r["n"]
    shift = rows.sparkSession.createDataFrame(shifts, "part int, shift long")  # a row for each partition
    out = ordered.join(F.broadcast(shift), "part").withColumn("id", F.col("at") + F.col("shift"))
    return out.drop("part", "at", "shift"), ordered, total - after
