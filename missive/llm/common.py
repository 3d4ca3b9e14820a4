"""Helpers shared by the corpus operators: shared scratch space, Arrow text
access and vectorised tokenisation on UTF-8 bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and make checkpoints possible.

    The checkpoint folder is the one named in ``spark.checkpoint.dir``; only
    where that is unset (tests on one machine) a local one is chosen.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the
    one that the context was given. Only a session on one machine may have neither."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files
    which outlive any executor."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/missive-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again, and release the shuffle files behind them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs: Spark frees them when the driver's collector
    finds their plans unused, which in a small driver with much memory left can be late."""
    spark._jvm.java.lang.System.gc()


def fold(column: str, modulus: int):
    """crc32 of the id's decimal text modulo `modulus`; null counts as text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


# ---------------------------------------------------------------- Arrow text


def joined(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as ''."""
    column = pc.fill_null(joined(column), "")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch holding about `most_bytes` of text each, one row at least."""
    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _table(keep) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for b in range(256) if keep(b)]] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all words run together, the words' offsets in them,
    and for each row the range of its words."""
    low = LOWER[data]
    inside = kind[low]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    lengths = np.flatnonzero(last) + 1 - starts
    bounds = np.searchsorted(starts, offsets)
    return low[inside], np.concatenate([[0], np.cumsum(lengths)]), bounds


def coded(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, and the distinct words as an Arrow binary array."""
    n = len(offsets) - 1
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    found = array.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hashed(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct byte strings."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
