"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of the LENGTHS in lower case, with every
run of other ASCII characters as one space, hashed into BUCKETS; the kernel of
two texts is the size of the shared set over the geometric mean of both sizes.
Kernel ridge regression, one language against the rest, is solved on Nystrom
landmarks taken from the training sample. As the kernel is linear in the
presence vectors, the landmarks and weights fold into one matrix of BUCKETS rows
and a column for each language, and a block of texts is scored by one product of
its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTHS = (2, 3, 4)
BUCKETS = 1 << 15
#: Bounds of what is fitted on the driver: rows in all, as bitmaps of BUCKETS bits; landmarks among them.
SAMPLE_ROWS = 4000
LANDMARKS = 400
RIDGE = 1e-2
UNDETERMINED = "und"
_BLOCK = 64

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def presence(column) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of rows with their presence matrices; null counts as empty."""
    data, offsets = common.text_bytes(column)
    folded = _FOLD[data]
    for at in range(0, len(offsets) - 1, _BLOCK):
        cut = offsets[at : at + _BLOCK + 1]
        text, bounds = folded[cut[0] : cut[-1]], cut - cut[0]
        # a run of spaces within a row becomes one
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 0x20) | (text[:-1] != 0x20)
        keep[bounds[:-1][bounds[:-1] < len(text)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        text, bounds = text[keep].astype(np.uint32), kept[bounds]
        out = np.zeros((len(bounds) - 1, BUCKETS), np.float32)
        row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
        code = text.copy()
        for n in range(2, max(LENGTHS) + 1):
            if len(text) < n:
                break
            code = code[:-1] << np.uint32(8) | text[n - 1 :]
            if n in LENGTHS:
                within = row[: len(code)] == row[n - 1 :]
                bucket = (code * np.uint32(2654435761) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(17)
                out.reshape(-1)[(row[: len(code)] * BUCKETS + bucket)[within]] = 1
        yield slice(at, at + len(bounds) - 1), out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 20):
            bits = [bytes(row) for _, block in presence(part.column("text")) for row in np.packbits(block.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])


class Model:
    """Learned languages and the folded matrix."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, block: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))
        raw = np.clip((block @ self.weights / size + 1) / 2, 1e-6, 1)
        return raw / raw.sum(axis=1, keepdims=True)


def _unpacked(packed: np.ndarray) -> np.ndarray:
    """Presence rows of unit length from bitmaps."""
    rows = np.unpackbits(packed, axis=1).astype(np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    return rows


def solve(packed: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """Nystrom kernel ridge regression of one-versus-rest targets on bitmaps, which
    are unpacked a few at a time."""
    # landmarks in turn from every language, so that none is without
    rank = np.zeros(len(labels), np.int64)
    for k in range(len(languages)):
        own = np.flatnonzero(labels == k)
        rank[own] = np.arange(len(own))
    marks = _unpacked(packed[np.lexsort((labels, rank))[:LANDMARKS]])
    across = np.concatenate([_unpacked(packed[i : i + 128]) @ marks.T for i in range(0, len(packed), 128)])
    among = marks @ marks.T
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    weight = share[labels][:, None] * len(labels) / len(languages)
    gram = across.T @ (across * weight) + RIDGE * len(labels) / 100 * among + 1e-6 * np.eye(len(marks))
    alpha = np.linalg.solve(gram.astype(np.float64), (across.T @ (target * weight)).astype(np.float64))
    # some buckets at a time, as marks take twice their room in the precision of alpha
    weights = [(marks[:, i : i + 2048].T @ alpha).astype(np.float32) for i in range(0, BUCKETS, 2048)]
    return Model(languages, np.concatenate(weights))


def fit(rows: DataFrame) -> Model:
    """Fit on rows(doc_id, text, lang) with a language: a sample of at most about
    SAMPLE_ROWS, evenly over the languages, drawn by a hash of the id. Of more than
    SAMPLE_ROWS // 8 languages the most frequent are learned. The sample
    reaches the driver as bitmaps of fixed size."""
    rows = rows.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS // 8).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    each = SAMPLE_ROWS // len(languages)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) < share[F.col("lang")]
    sample = rows.filter(drawn).mapInArrow(_bitmaps, "doc_id long, lang string, bits binary").orderBy(F.xxhash64("doc_id"), "bits").limit(2 * SAMPLE_ROWS).collect()
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in sample), np.uint8).reshape(len(sample), -1)
    labels = np.array([languages.index(r["lang"]) for r in sample])
    del sample
    return solve(packed, labels, languages)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score for each row of docs, with the columns in `keep` (or doc_id);
    columns of docs with either name give way.

    A text that is null, empty or without a letter is UNDETERMINED with score 0,
    as is every text if no language was learned. Repeated rows are judged each.
    """
    common.prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    other = [c for c in keep if c != "text"]
    names = np.array([*model.languages, UNDETERMINED], object)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for part in common.slices(batch, "text_", 4 << 20):
                best = np.full(part.num_rows, len(names) - 1)
                score = np.zeros(part.num_rows)
                if own.languages:
                    for rows, block in presence(part.column("text_")):
                        found = own.scores(block)
                        best[rows], score[rows] = found.argmax(axis=1), found.max(axis=1)
                letter = part.column("letter_").to_numpy(zero_copy_only=False).astype(bool)
                best[~letter], score[~letter] = len(names) - 1, 0.0
                out = {f"keep{i}_": part.column(f"keep{i}_") for i in range(len(other))}
                if "text" in keep:
                    out["text_"] = part.column("text_")
                yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)})

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter_")
    inner = {c: f"keep{i}_" for i, c in enumerate(other)}
    rows = docs.select(*[F.col(c).alias(k) for c, k in inner.items()], F.col("text").alias("text_"), letter)
    if "text" in keep:
        inner["text"] = "text_"
    ddl = ", ".join([f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in inner.items()] + ["lang_pred string", "score double"])
    found = rows.mapInArrow(apply, ddl)
    return found.select(*[F.col(inner[c]).alias(c) for c in keep if c not in ("lang_pred", "score")], "lang_pred", "score")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(common.fold("doc_id", 5) != 0))
    return identify(docs, model).select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
