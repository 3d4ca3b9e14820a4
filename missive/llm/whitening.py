"""Whitening of embeddings by a covariance that is summed in tiles.

A vector's entries c become whole numbers x = floor(64 * c) + 1000000. The distinct
x vectors are the list that is fitted. Its rows are cut into blocks of BLOCK rows and
each block into columns of TILE dimensions; a column block is sent to every tile (a
pair of column ranges) that it belongs to, keyed by block and tile. There the two
sides are centred and multiplied, products are summed for each tile, and the sums are
assembled into one matrix, whose size depends on the dimension alone. A vector that
very many rows share is one row of the list, so no key grows with a group of copies.

Left out are rows whose vector is null, empty or holds a null, a NaN, an infinity or
an entry of 2**50 or more (whose x would be no exact number), and rows whose vector is
not as long as most distinct ones are (ties: the longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
TILE = 32
BLOCK = 4096
COMPONENTS = 16
LARGEST = float(1 << 50)
#: Eigenvalues under this share of the trace are rounding: the list has no spread there.
LEAST_SHARE = 1e-13


@dataclass
class Model:
    """x = whole + (part / n) + spread, with eigenvectors in the columns of `vectors`."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = field(default=0.0)

    @property
    def dims(self) -> int:
        return len(self.whole)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part / self.n

    def projection(self) -> np.ndarray:
        """Columns that whiten; NaN for components without spread."""
        e = np.where(self.values > LEAST_SHARE * self.trace, self.values, np.nan)
        return self.vectors / np.sqrt(e)


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))


def entries(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _matrix(column: pa.Array) -> np.ndarray:
    column = common.joined(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def tiled(rows: DataFrame, dims: int, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sum over rows(x: array) of the outer product of x - whole - part with itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = _matrix(batch.column("x"))
            for i in range(0, len(x), BLOCK):
                sides = [np.ascontiguousarray(x[i : i + BLOCK, at : at + TILE]) for at in range(0, dims, TILE)]
                yield pa.RecordBatch.from_pydict({"block": [block] * len(sides), "side": range(len(sides)), "data": [s.tobytes() for s in sides]}, schema=_CUT)
                block += 1

    kind = np.int64 if dict(rows.dtypes)["x"] == "array<bigint>" else np.float64

    def side(number: int, data: bytes) -> np.ndarray:
        at = slice(number * TILE, min(dims, (number + 1) * TILE))
        return np.frombuffer(data, kind).reshape(-1, at.stop - at.start) - whole[at] - part[at]

    def product(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        sides = {n: side(n, d) for n, d in zip(both["side"], both["data"], strict=True)}
        return pd.DataFrame({"left": [key[1]], "right": [key[2]], "sums": [(sides[key[1]].T @ sides[key[2]]).ravel()]})

    sides = -(-dims // TILE)
    tiles = F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda o: F.struct(F.least(o, "side").alias("left"), F.greatest(o, "side").alias("right")))
    sent = rows.select("x").mapInArrow(cut, "block long, side int, data binary").select("block", "side", "data", F.explode(tiles).alias("tile"))
    products = sent.select("block", "tile.left", "tile.right", "side", "data").groupBy("block", "left", "right").applyInPandas(product, "left int, right int, sums array<double>")
    summed = products.select("left", "right", F.posexplode("sums").alias("at", "s")).groupBy("left", "right", "at").agg(F.sum("s").alias("s")).toArrow()
    left, right, at, s = (summed.column(c).to_numpy() for c in ("left", "right", "at", "s"))
    out = np.zeros((dims, dims))
    width = np.minimum(TILE, dims - right * TILE)
    i, j = left * TILE + at // width, right * TILE + at % width
    out[i, j] = out[j, i] = s
    return out


_CUT = pa.schema([("block", pa.int64()), ("side", pa.int32()), ("data", pa.binary())])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model:
    """Fit on the distinct arrays of vectors(x: array<long>), each once."""
    common.prepare(vectors.sparkSession)
    distinct = common.stored(vectors.select("x").distinct())
    most = distinct.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        return Model(0, *[np.zeros(0)] * 3, np.zeros((0, 0)), 0.0)
    dims, n = most[0]
    rows = distinct.filter(F.size("x") == dims)
    # sums of high and low halves, each within a long whatever the entries are
    halves = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.shiftright("v", 32)).alias("high"), F.sum(F.col("v").bitwiseAND(0xFFFFFFFF)).alias("low"))
    sums = [(r["high"] << 32) + r["low"] for r in halves.orderBy("at").collect()]
    whole, part = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    covariance = tiled(rows, dims, whole, part / n) / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    model = Model(n, whole, part, values[order], axes[:, order], float(np.trace(covariance)))
    keep = np.flatnonzero(~np.isnan(model.projection()[0]))
    if len(keep):
        onto = model.projection()[:, keep]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = model.centred(_matrix(batch.column("x"))) @ onto
                yield pa.RecordBatch.from_arrays([_listed(y)], names=["x"])

        none = np.zeros(len(keep))
        again = tiled(rows.mapInArrow(project, "x array<double>"), len(keep), none, none) / n
        model.identity_error = float(np.abs(again - np.eye(len(keep))).max())
    common.dropped(distinct)
    return model


def _listed(y: np.ndarray) -> pa.Array:
    flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), flat)


def _deviation(model: Model, x: np.ndarray) -> pa.Array:
    """Exact sums of (n * x - S) ** 2; null where they have more than 38 digits."""
    off = (x - model.whole) * model.n - model.part  # arithmetic modulo 2 ** 64 is exact for results under 2 ** 63
    about = np.sum(((x - model.whole) * float(model.n) - model.part) ** 2, axis=1)
    found = np.sum(off * off, axis=1)
    kind = pa.decimal128(38, 0)
    if (about < 2.0**62).all():
        return pa.array(found).cast(kind)
    exact = [sum((model.n * int(a) - int(b)) ** 2 for a, b in zip(row, model.part, strict=True)) for row in (x - model.whole)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], kind)


def whiten(rows: DataFrame, model: Model, x: str = "x") -> DataFrame:
    """Usable rows with two more columns: deviation decimal(38,0) and whitened
    array<double>, an entry for each component, null where the list has no spread.
    Columns of rows with either name give way; repeated rows are whitened each."""
    onto = model.projection() if model.n else np.zeros((0, 0))

    def apply(column: pa.Array) -> pa.Array:
        matrix = _matrix(column).reshape(len(column), model.dims)
        return pa.StructArray.from_arrays([_deviation(model, matrix), _listed(model.centred(matrix) @ onto)], names=["deviation", "whitened"])

    of_length = rows.filter(F.size(x) == model.dims)
    found = F.arrow_udf(apply, "struct<deviation: decimal(38,0), whitened: array<double>>")(F.col(x))
    kept = [c for c in rows.columns if c not in ("deviation", "whitened")]
    inner = max(rows.columns, key=len) + "_"  # a name that no column has
    return of_length.select(*kept, found.alias(inner)).select(*kept, f"{inner}.deviation", f"{inner}.whitened")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).select("vec_id", entries(F.col("embedding")).alias("x"))
    model = fit(vectors)
    explained = F.array(*[F.lit(float(e)) for e in model.values / model.trace]) if model.trace else F.array(F.lit(None).cast("double"))
    each = whiten(vectors, model).select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
