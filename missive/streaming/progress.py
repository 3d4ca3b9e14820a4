"""How far an import has come: records read of those that its files say they hold.

The first element of a backup file may say how many records follow. While tasks end, two
accumulators tell what was announced and what was read; a task that runs again adds its
share again, so until a scan is over these are estimates. Then the metrics that Spark
observed on the scan's rows take their place, which count every row once.
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Progress:
    """The state of one import, or of a stream's batches so far; threads may share it."""

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        self._lock, self._observed = Lock(), None
        self._total, self._records = context.accumulator(0), context.accumulator(0)
        self._known, self._before = {"total": 0, "records": 0, "errors": 0}, (0, 0)

    def counters(self) -> tuple:
        """Accumulators (announced, read) for the tasks of a scan."""
        return self._total, self._records

    def begin(self, rows: DataFrame) -> DataFrame:
        """A scan's rows (`ranges.scanned`), to be read in place of them."""
        with self._lock:
            self._before = self._total.value, self._records.value
            self._observed = Observation()
        own = F.col("kind").isin("sms", "mms", "call") & (~F.col("part") | F.col("start").isNotNull())
        return rows.observe(
            self._observed,
            F.coalesce(F.sum(F.when(F.col("kind") == "root", F.col("attrs")["count"].try_cast("long"))), F.lit(0)).alias("total"),
            F.count_if(own).alias("records"),
            F.count_if(F.col("kind") == "error").alias("errors"),
        )

    def end(self) -> None:
        """The scan's rows were read; from here on its figures are exact."""
        found = self._observed.get
        with self._lock:
            self._known = {name: n + found[name] for name, n in self._known.items()}
            self._observed = None

    def drop(self) -> None:
        """The scan failed: what it had read counts no longer."""
        with self._lock:
            self._observed = None

    def status(self) -> dict:
        """total (null: no file says), records, errors, and whether a scan is running."""
        with self._lock:
            out, running = dict(self._known), self._observed is not None
            if running:
                out["total"] += self._total.value - self._before[0]
                out["records"] += self._records.value - self._before[1]
        return out | {"total": out["total"] or None, "running": running}
