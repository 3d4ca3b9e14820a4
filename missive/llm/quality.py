"""Quality classifier by compression with class dictionaries.

Two zstandard dictionaries are built, from good and from bad labelled text. A
text is compressed with each, in pieces of PIECE bytes so that the dictionary
and not the text's own history does the work; the difference of the two sizes,
divided by their sum, is the evidence. A logistic curve fitted on labelled rows
that no dictionary has seen turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bounds of the labelled sample that is fitted on the driver: rows of each label, bytes of text in all.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 64 << 20
DICTIONARY_BYTES = 48 << 10
PIECE = 256
LEVEL = 3
#: Every CALIBRATE-th sampled row fits the curve, the others the dictionaries.
CALIBRATE = 3


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _dictionary(texts: list[str | None]) -> bytes:
    import zstandard

    pieces = [p for t in texts for p in _pieces(t)]
    step = max(1, len(pieces) * PIECE // (8 << 20))  # its builder reads 8 MB of the sample, evenly taken
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces[::step]).as_bytes()
    except zstandard.ZstdError:  # too few pieces to choose from: take them as they are
        return b"".join(pieces)[-DICTIONARY_BYTES:]


class Evidence:
    """The normalised difference of a text's two compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def of(self, text: str | None) -> float:
        pieces = _pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in (self.good, self.bad))
        return (bad - good) / (bad + good) if pieces else 0.0


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a slight ridge."""
    scale = float(np.std(x)) or 1.0
    features = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - y) + 1e-3 * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float, intercept: float):
        self.good, self.bad, self.slope, self.intercept = good, bad, slope, intercept

    def scores(self, texts: list[str | None], evidence: Evidence) -> np.ndarray:
        x = np.array([evidence.of(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on docs(doc_id, text) labelled in labels(doc_id, quality), at most
    SAMPLE_ROWS rows of each label, the first by a hash of their id until their
    texts reach half of SAMPLE_BYTES characters (one row at least; of rows that
    repeat an id, the least text). With rows of one label only, or none, the score is that label's share, or 1/2."""
    spark = docs.sparkSession
    ids = []
    for label in (0, 1):
        first = labels.filter(F.col("quality") == label).select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        ids += [(r["doc_id"], label) for r in first.collect()]
    wanted = spark.createDataFrame(ids or [(None, None)], "doc_id long, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    room = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    sized = rows.withColumn("before", F.coalesce(room, F.lit(0))).filter(F.col("before") < SAMPLE_BYTES // 2)
    kept = sorted(((r["doc_id"], r["label"], r["text"]) for r in sized.collect()), key=lambda r: r[:2])
    n = {label: sum(r[1] == label for r in kept) for label in (0, 1)}
    if not n[0] or not n[1]:
        share = (n[1] + 0.5) / (n[0] + n[1] + 1)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    classes = {label: [r for r in kept if r[1] == label] for label in (0, 1)}
    learn = {label: [r[2] for i, r in enumerate(c) if len(c) < CALIBRATE or i % CALIBRATE] for label, c in classes.items()}
    check = {label: [r[2] for i, r in enumerate(c) if len(c) < CALIBRATE or not i % CALIBRATE] for label, c in classes.items()}
    good, bad = _dictionary(learn[1]), _dictionary(learn[0])
    evidence = Evidence(good, bad)
    x = np.array([evidence.of(t) for label in (0, 1) for t in check[label]])
    y = np.array([label for label in (0, 1) for _ in check[label]])
    weight = {label: labels_share for label, labels_share in _shares(labels).items()}
    slope, intercept = _curve(x, y)
    # the sample is even by design; the labels' own odds return in the intercept
    odds = (weight[1] / weight[0]) / (len(check[1]) / len(check[0]))
    return Model(good, bad, slope, intercept + float(np.log(odds)))


def _shares(labels: DataFrame) -> dict[int, int]:
    counted = {r["quality"]: r["n"] for r in labels.filter(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    return {label: max(1, counted.get(label, 0)) for label in (0, 1)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted for each row of docs.
    Null and empty texts give no evidence and get the score of a difference of 0."""
    common.prepare(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.good, model.bad)
        for batch in batches:
            for part in common.slices(batch, "text", 8 << 20):
                found = model.scores(part.column("text").to_pylist(), evidence)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").filter(common.fold("doc_id", 3) != 1)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
