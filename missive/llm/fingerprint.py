"""Document fingerprints from prefix polynomial hashes.

For a text c the prefix array holds S[i] = sum of (c[j] + 1) * B**j for j < i,
modulo a prime, for two primes at once. The hash of any span follows from two
entries of S, so two spans are compared in constant time, and the longest common
extension of two places is found by binary search over span lengths. A
fingerprint holds the length, the hash of the whole text and the SKETCH least
scrambled hashes of its spans of SPAN code points; the likeness of two
fingerprints is the Dice coefficient of their span sets as estimated from these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 972_663_749)
SPAN = 8
SKETCH = 64

_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base**j mod prime for j < n at least; the table grows by doubling and is kept."""
    table = _powers.get((base, prime))
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < n:
        step = int(table[-1]) * base % prime
        table = np.concatenate([table, table * np.uint64(step) % np.uint64(prime)])
    _powers[base, prime] = table
    return table[:n]


class PrefixHashes:
    """Span hashes of one text, by code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums, self.inverses = [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            terms = points * _power_table(base, prime, self.n) % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]) % np.uint64(prime))
            self.inverses.append(_power_table(pow(base, -1, prime), prime, self.n + 1))

    def span(self, start: int, end: int) -> int:
        """62-bit hash of the code points in [start, end)."""
        out = 0
        for sums, inverse, prime in zip(self.sums, self.inverses, PRIMES, strict=True):
            out = out << 31 | (int(sums[end]) - int(sums[start])) * int(inverse[start]) % prime
        return out

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of a length, by their start."""
        out = np.zeros(max(0, self.n - length + 1), np.uint64)
        for sums, inverse, prime in zip(self.sums, self.inverses, PRIMES, strict=True):
            p = np.uint64(prime)
            out = out << np.uint64(31) | (sums[length:] + p - sums[: len(out)]) % p * inverse[: len(out)] % p
        return out

    def same(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension of place i here and place j in other."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def sketch(self) -> np.ndarray:
        """The least SKETCH distinct scrambled span hashes; a text of under 3 * SPAN code points has shorter spans."""
        if not self.n:
            return np.zeros(0, np.uint32)
        found = common.mixed(self.spans(max(1, min(SPAN, self.n // 3))))
        if len(found) > 16 * SKETCH:
            few = found[found < np.uint64(int((1 << 64) * (8 * SKETCH / len(found))))]
            few = np.unique(few)
            if len(few) >= SKETCH:
                return (few[:SKETCH] >> np.uint64(32)).astype(np.uint32)
        return (np.unique(found)[:SKETCH] >> np.uint64(32)).astype(np.uint32)


class Fingerprint:
    def __init__(self, text: str):
        self.hashes = PrefixHashes(text)
        self.sketch = self.hashes.sketch()
        self.text = f"{self.hashes.n:x}-{self.hashes.span(0, self.hashes.n):016x}-{self.sketch.astype('>u4').tobytes().hex()}"


def _sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.rpartition("-")[2]), ">u4")


def likeness(a: str, b: str) -> float:
    """Estimated Dice coefficient of two fingerprints' span sets: 1 for equal
    fingerprints, 0 if just one is of an empty text."""
    if a == b:
        return 1.0
    return _like(_sketch_of(a), _sketch_of(b))


def _like(x: np.ndarray, y: np.ndarray) -> float:
    least = np.union1d(x, y)[:SKETCH]
    if not len(least):
        return 1.0
    shared = int(np.isin(least, np.intersect1d(x, y, assume_unique=False)).sum()) / len(least)
    return 2 * shared / (1 + shared)


def edited(text: str, after: str) -> str:
    """The last third replaced by as much of the beginning of another text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each bucket ends with a copy of the row that follows it."""
    before: tuple | None = None
    for batch in batches:
        out = []
        for bucket, halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if halo and (before is None or before[0] != bucket):
                before = None
                continue
            text = text or ""
            now = Fingerprint(text)
            if before is not None and before[0] == bucket:
                _, last_id, last_text, last = before
                new_text = edited(last_text, text)
                new = Fingerprint(new_text)
                out.append(
                    {
                        "doc_id": last_id,
                        "n_chars": len(last_text),
                        "edited_sha256": hashlib.sha256(new_text.encode()).hexdigest(),
                        "fingerprint": last.text,
                        "edited_fingerprint": new.text,
                        "near_edited": 1.0 if last.text == new.text else _like(last.sketch, new.sketch),
                        "near_next": 1.0 if last.text == now.text else _like(last.sketch, now.sketch),
                        "common_prefix": last.hashes.extension(0, new.hashes, 0),
                    }
                )
            before = None if halo else (bucket, doc_id, text, now)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, one row for each row.

    The next document is the one that follows by descending doc_id; a null
    doc_id comes last, rows that repeat an id are ordered by text, and after the
    last row comes the first. Null text is empty. common_prefix is the longest
    common extension of both texts' beginnings. An empty table gives no rows.

    Rows are dealt into buckets by id ranges. The first row of every bucket is
    copied to the end of the bucket before it, so that each is walked alone.
    """
    common.prepare(docs.sparkSession)
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce("doc_id", F.lit(lowest)))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 20 * n).alias("cuts")).collect()[0][0] or []
    places = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def place(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at.to_numpy(), side="left").astype(np.int32))

    tops = rows.select("at", place("at").alias("bucket")).groupBy("bucket").agg(F.max("at").alias("at")).orderBy("bucket").collect()
    into = [(r["at"], tops[(i + 1) % len(tops)]["bucket"]) for i, r in enumerate(tops)]
    first = spark.createDataFrame(into or [(None, None)], "at long, bucket int")
    own = rows.select(place("at").alias("bucket"), F.lit(False).alias("halo"), "doc_id", "text", "at")
    halo = rows.join(F.broadcast(first), "at").select("bucket", F.lit(True).alias("halo"), "doc_id", "text", "at")
    dealt = own.unionByName(halo).repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc("at"), "text")
    return dealt.select("bucket", "halo", "doc_id", "text").mapInArrow(_walk, _DDL)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(common.table(spark, sf_dir, "documents"))
