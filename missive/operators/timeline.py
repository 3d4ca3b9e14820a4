"""Pages of a table that is kept in time order.

Rows are dealt to files by ranges of (date, id) and sorted within them; a small table of
bounds, a row for each file, says what each holds and how many rows come before it. A
page, by its number or by the row that it follows, then reads the files that it lies in
and no others, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE_ROWS = 100_000
_KEY = "struct<date: long, id: long>"
_BOUNDS = f"file string, n long, first {_KEY}, last {_KEY}, before long"


class Timeline:
    """A folder with the rows of a table (date, id, ...) in the order of date and id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """Write the table anew; about file_rows rows go into a file."""
        files = max(1, -(-rows.count() // file_rows))
        rows.repartitionByRange(files, "date", "id").sortWithinPartitions("date", "id").write.mode("overwrite").parquet(f"{self.path}/rows")
        key = F.struct(F.col("date").cast("long").alias("date"), F.col("id").cast("long").alias("id"))
        each = self.spark.read.parquet(f"{self.path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
        before = F.coalesce(F.sum("n").over(W.orderBy("first", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over files, not rows
        each.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")

    def _read(self, bounds: DataFrame) -> tuple[DataFrame, int]:
        """Rows of some files, and how many rows of the table come before them."""
        found = bounds.orderBy("first", "file").collect()
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if not found:
            return rows.limit(0), 0
        return self.spark.read.schema(rows.schema).parquet(*[r["file"] for r in found]), found[0]["before"]

    def bounds(self) -> DataFrame:
        return self.spark.read.schema(_BOUNDS).parquet(f"{self.path}/bounds")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset to offset + limit of the whole."""
        rows, before = self._read(self.bounds().filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)))
        return rows.orderBy("date", "id").offset(offset - before).limit(limit)

    def following(self, limit: int, date: int, id_: int) -> DataFrame:
        """The next rows after one, which itself need not be there."""
        key = F.struct(F.lit(date).cast("long").alias("date"), F.lit(id_).cast("long").alias("id"))
        there = self.bounds().filter(F.col("last") > key)
        rows, _ = self._read(self._enough(there, limit, F.col("first") <= key, W.orderBy("first", "file")))
        return rows.filter(F.struct(F.col("date").cast("long").alias("date"), F.col("id").cast("long").alias("id")) > key).orderBy("date", "id").limit(limit)

    def preceding(self, limit: int, date: int | None = None, id_: int | None = None) -> DataFrame:
        """The rows before one, or the last of all, in order of time."""
        there, cut, past = self.bounds(), F.lit(True), F.lit(False)
        if date is not None:
            key = F.struct(F.lit(date).cast("long").alias("date"), F.lit(id_).cast("long").alias("id"))
            there, past = there.filter(F.col("first") < key), F.col("last") >= key
            cut = F.struct(F.col("date").cast("long").alias("date"), F.col("id").cast("long").alias("id")) < key
        rows, _ = self._read(self._enough(there, limit, past, W.orderBy(F.desc("first"), F.desc("file"))))
        return rows.filter(cut).orderBy(F.desc("date"), F.desc("id")).limit(limit).orderBy("date", "id")

    @staticmethod
    def _enough(bounds: DataFrame, limit: int, partly, order) -> DataFrame:
        """The first files in an order that hold limit rows, not counting one that is cut."""
        whole = F.when(partly, 0).otherwise(F.col("n"))
        earlier = F.coalesce(F.sum(whole).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return bounds.withColumn("earlier", earlier).filter(F.col("earlier") < limit).drop("earlier")
