"""Continuous import of a drop directory, with Structured Streaming.

Files are found by the file source, which remembers what it has read, and read in
pieces, so that their size does not matter. A batch is committed to the store once: one
that runs again after a failure finds its own log and only moves its files. A file
without an error moves to the archive, a failed one stays where it is. Files must be
renamed into the directory when they are complete, or come by way of `arrivals`.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from missive.operators.store import Store
from missive.session import Files
from missive.sources import ranges
from missive.streaming.progress import Progress


def watch(spark: SparkSession, inbox: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of the pieces of the XML files of a drop directory."""
    own = spark.newSession()  # both passes over a batch must cut its files alike
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    reader = own.readStream.format("text").option("lineSep", "<").option("pathGlobFilter", ranges.NAMES).option("maxFilesPerTrigger", files_per_batch)
    return ranges.cut(reader.load(inbox))


def start(spark: SparkSession, inbox: str, store: Store, checkpoint: str, archive: str | None = None, once: bool = False, every: str = "1 minute", after: Callable[[DataFrame, int], None] | None = None, progress: Progress | None = None) -> StreamingQuery:
    """Import every file that arrives; `once` takes what is there and ends. A progress adds up
    over its batches."""

    def batch(pieces: DataFrame, number: int) -> None:
        done = store.append(pieces, checkpoint, number, progress)
        if archive:
            for r in done.filter("status = 'completed'").select("file").collect():  # of one batch
                Files(spark).move(r["file"], archive)
        if after:
            after(done, number)

    writer = watch(spark, inbox).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def log(store: Store) -> DataFrame:
    """(batch, file, status, records, logged_at) of the files that streams imported."""
    return store.files().filter("number IS NOT NULL").select(F.col("number").alias("batch"), "file", "status", "records", "logged_at")


class Jobs(StreamingQueryListener):
    """Imports one after another, in the order in which they were submitted, with their
    states: queued, processing, completed or error, and what was read of what was announced.
    The caller goes on while they wait and run. Streams that it listens to have states too."""

    def __init__(self) -> None:
        self._lock, self._jobs = Lock(), {}
        self._queue = ThreadPoolExecutor(max_workers=1, thread_name_prefix="import")
        self._running: dict[str, Future] = {}

    def submit(self, tenant: str, path: str, work: Callable[[], DataFrame], progress: Progress | None = None) -> str:
        """Queue an import, whose work returns its log, and return its new id. A progress that
        the work hands to the store shows in its state."""
        job = uuid4().hex
        self._set(job, tenant=tenant, path=path, status="queued", **({"progress": progress} if progress else {}))
        with self._lock:
            self._running[job] = self._queue.submit(self._run, job, work)
        return job

    def _run(self, job: str, work: Callable[[], DataFrame]) -> None:
        self._set(job, status="processing")
        try:
            row = work().agg(F.count_if(F.col("status") == "error").alias("failed"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
            self._set(job, status="error" if row["failed"] else "completed", records=row["records"])
        except Exception as e:  # the state is what tells of it, and the next job runs all the same
            self._set(job, status="error", error=str(e))

    def wait(self, job: str, seconds: float | None = None) -> None:
        """Return when a job has ended; TimeoutError after so many seconds."""
        with self._lock:
            running = self._running.get(job)
        if running is not None:
            running.result(seconds)

    def close(self) -> None:
        """Take no more jobs, and return when the queued ones have ended."""
        self._queue.shutdown()

    def status(self, tenant: str, job: str) -> dict | None:
        """A job's state, for its own tenant only."""
        with self._lock:
            found = self._jobs.get(job)
            found = dict(found) if found and found["tenant"] == tenant else None
        if found and "progress" in found:
            now = found.pop("progress").status()
            found |= {"total": now["total"], "processed": now["records"]}
        return found

    def _set(self, job: str, **fields) -> None:
        with self._lock:
            self._jobs.setdefault(job, {}).update(fields)

    def onQueryStarted(self, event) -> None:
        self._set(str(event.id), tenant="", status="processing", records=0)

    def onQueryProgress(self, event) -> None:
        with self._lock:
            job = self._jobs.setdefault(str(event.progress.id), {"tenant": "", "records": 0})
            job["records"] = job.get("records", 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._set(str(event.id), status="error" if event.exception else "completed")
