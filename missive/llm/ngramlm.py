"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram, unigram and uniform
estimates; the weights depend on how often the context was seen, by powers of
two. They are learned by expectation-maximisation on training documents that are
held out of the counts for that purpose; the counts for scoring then include them.

Documents are cut into segments of bounded size, each with its own vocabulary.
A segment asks for the corpus counts of its distinct unigrams and bigrams: their
hashes, packed and cut by their leading bits, meet in as many partitions as the
corpus needs, are summed there, and the sums return to the segment in the same
order. So a gram is shuffled once for each segment that holds it, and no table
of the corpus is sent to every task. From the held-out segments come histograms
over a fixed grid (context bucket, bigram and unigram likelihood ratio), which
are all that the driver needs for the maximisation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Text of a segment; grams that meet in one partition, about.
SEGMENT_BYTES = 6 << 20
PARTITION_GRAMS = 1_000_000
BUCKETS = 40
#: Steps of likelihood ratios in the grid for an octave, and their largest number.
STEPS, MOST_STEP = 4, 200
ITERATIONS = 100
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Hash of the end of a document, which is also the context of the first token.
_END = np.uint64(0xE17A1465D0C5A5B1)

COUNTED, HELD, OTHER = 0, 1, 2

_SEGMENT_DDL = "segment long, kind int, doc_ids array<long>, tokens array<int>, vocabulary binary, codes binary"
_SEGMENT = pa.schema([("segment", pa.int64()), ("kind", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("codes", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """32-bit values as four byte planes, which compress well when most are small."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _segment(batches: list[pa.RecordBatch], number: int, kind: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    data, offsets = common.text_bytes(rows.column("text"))
    flat, at, bounds = common.words(data, offsets, common.NONSPACE)
    codes, distinct = common.coded(flat, at)
    docs = len(bounds) - 1
    stream = np.empty(len(codes) + docs, np.int64)
    ends = bounds[1:] + np.arange(docs)
    inner = np.ones(len(stream), bool)
    inner[ends] = False
    stream[inner] = codes
    stream[ends] = len(distinct)
    vocabulary = np.append(common.hashed(distinct), _END)
    order = np.argsort(-np.bincount(stream, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return pa.RecordBatch.from_pylist(
        [{"segment": number, "kind": kind, "doc_ids": rows.column("doc_id").to_pylist(), "tokens": (np.diff(bounds) + 1).tolist(), "vocabulary": vocabulary[order].tobytes(), "codes": _planes(rank[stream])}], schema=_SEGMENT
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 20):
            kinds = part.column("kind").to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds).tolist():
                own = part.filter(pa.array(kinds == kind))
                held.setdefault(kind, []).append(own)
                size[kind] = size.get(kind, 0) + own.get_total_buffer_size()
                if size[kind] >= SEGMENT_BYTES:
                    yield _segment(held.pop(kind), number, kind)
                    size[kind], number = 0, number + 1
    for kind in sorted(held):
        yield _segment(held[kind], number, kind)
        number += 1


class Grams:
    """A segment's tokens and contexts, and its distinct grams in the order of their hashes."""

    def __init__(self, vocabulary: bytes, codes: bytes):
        words = np.frombuffer(vocabulary, np.uint64)
        self.token = _from_planes(codes)
        end = int(np.flatnonzero(words == _END)[0])
        self.context = np.concatenate([[end], self.token[:-1]])
        order = np.argsort(words, kind="stable")
        self.unigrams = words[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.unigram_n = np.bincount(self.place[self.token], minlength=len(order))
        pairs, inverse, n = np.unique(self.context * len(words) + self.token, return_inverse=True, return_counts=True)
        hashes = common.mixed(words[pairs // len(words)] * _STEP + words[pairs % len(words)])
        order = np.argsort(hashes, kind="stable")
        self.bigrams, self.bigram_n = hashes[order], n[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[inverse]


def _packed(hashes: np.ndarray, bits: int, short: bool) -> bytes:
    """Hashes without their leading bits; of bigrams the next 48 bits."""
    if not short:
        return hashes.tobytes()
    left = (hashes << np.uint64(bits)) >> np.uint64(16)
    return np.ascontiguousarray(left.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes, short: bool) -> np.ndarray:
    if not short:
        return np.frombuffer(data, np.uint64)
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_ASK_DDL = "size int, part long, segment long, kind int, hashes binary, counts binary"


def _ask(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                segment, kind = row.column("segment")[0].as_py(), row.column("kind")[0].as_py()
                grams = Grams(row.column("vocabulary")[0].as_py(), row.column("codes")[0].as_py())
                for size, hashes, counts in ((1, grams.unigrams, grams.unigram_n), (2, grams.bigrams, grams.bigram_n)):
                    part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                    parts, starts = np.unique(part, return_index=True)
                    ends = [*starts[1:], len(part)]
                    out = {
                        "size": pa.array([size] * len(parts), pa.int32()),
                        "part": pa.array(parts),
                        "segment": pa.array([segment] * len(parts), pa.int64()),
                        "kind": pa.array([kind] * len(parts), pa.int32()),
                        "hashes": pa.array([_packed(hashes[a:b], bits, size == 2) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        "counts": pa.array([_planes(counts[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    }
                    yield pa.RecordBatch.from_pydict(out)

    return emit


_ANSWER = pa.schema([("size", pa.int32()), ("part", pa.int64()), ("segment", pa.int64()), ("total", pa.binary()), ("counted", pa.binary()), ("n", pa.list_(pa.int64()))])
_ANSWER_DDL = "size int, part long, segment long, total binary, counted binary, n array<long>"


def _answer(group: pa.Table) -> pa.Table:
    """Corpus counts of the grams that segments ask for; a row without a segment
    has how many tokens and distinct grams the part has, in all and without the held."""
    size, part = group["size"][0].as_py(), group["part"][0].as_py()
    segments, kinds = group["segment"].to_pylist(), group["kind"].to_pylist()
    asked = [_unpacked(h.as_py(), size == 2) for h in group["hashes"]]
    counts = np.concatenate([_from_planes(c.as_py()) for c in group["counts"]])
    kind = np.repeat(kinds, [len(a) for a in asked])
    distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    counted = np.bincount(inverse, counts * (kind == COUNTED), len(distinct)).astype(np.int64)
    total = np.bincount(inverse, counts * (kind != OTHER), len(distinct)).astype(np.int64)
    most = np.int64(0xFFFFFFFF)
    out = [{"size": size, "part": part, "segment": None, "total": None, "counted": None, "n": [int(x) for x in (total.sum(), (total > 0).sum(), counted.sum(), (counted > 0).sum())]}]
    at = 0
    for segment, k, own in zip(segments, kinds, asked, strict=True):
        where = inverse[at : at + len(own)]
        at += len(own)
        out.append({"size": size, "part": part, "segment": segment, "total": _planes(np.minimum(total[where], most)), "counted": _planes(np.minimum(counted[where], most)) if k == HELD else None, "n": None})
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _counts(answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of a segment's unigrams and bigrams, in the order of their hashes."""
    rows = sorted(answers.select(["size", "part", column]).to_pylist(), key=lambda r: (r["size"], r["part"]))
    one, two = ([_from_planes(r[column]) for r in rows if r["size"] == size] for size in (1, 2))
    return np.concatenate(one), np.concatenate(two)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def _estimates(grams: Grams, one: np.ndarray, two: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token: its context's count, the bigram and the unigram estimate."""
    context = one[grams.place[grams.context]]
    return context, two[grams.pair] / np.maximum(context, 1), one[grams.place[grams.token]] / max(tokens, 1)


def _histogram(tokens: int, distinct: int):
    def count(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows or not answers.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "two": pa.array([], pa.int32()), "one": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        grams = Grams(own["vocabulary"][0].as_py(), own["codes"][0].as_py())
        context, two, one = _estimates(grams, *_counts(answers, "counted"), tokens)
        step = lambda p: np.where(p > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(p, 1e-300) * (distinct + 1))) + MOST_STEP // 4, 1, MOST_STEP - 1), 0).astype(np.int64)
        cells, n = np.unique((_bucket(context) * MOST_STEP + step(two)) * MOST_STEP + step(one), return_counts=True)
        return pa.table({"bucket": pa.array(cells // MOST_STEP**2, pa.int32()), "two": pa.array(cells // MOST_STEP % MOST_STEP, pa.int32()), "one": pa.array(cells % MOST_STEP, pa.int32()), "n": pa.array(n, pa.int64())})

    return count


def maximise(cells: np.ndarray) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket, by expectation-
    maximisation over the rows (bucket, two, one, n) of the grid. A bucket without
    held-out tokens takes the weights of all buckets together."""
    ratio = lambda step: np.where(step > 0, 2.0 ** ((step - MOST_STEP // 4) / STEPS), 0.0)

    def learn(rows: np.ndarray) -> np.ndarray:
        parts = np.stack([ratio(rows[:, 1]), ratio(rows[:, 2]), np.ones(len(rows))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(ITERATIONS):
            share = parts * w
            share *= (rows[:, 3] / share.sum(axis=1))[:, None]
            new = share.sum(axis=0) / rows[:, 3].sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    whole = learn(cells) if len(cells) else np.array([0.6, 0.3, 0.1])
    out = np.tile(whole, (BUCKETS, 1))
    for bucket in np.unique(cells[:, 0]) if len(cells) else []:
        out[bucket] = learn(cells[cells[:, 0] == bucket])
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]  # an unseen context has no bigram estimate
    return out


_SCORE_DDL = "doc_id long, kind int, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: int, distinct: int, weights: np.ndarray):
    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(own["vocabulary"][0].as_py(), own["codes"][0].as_py())
        unigrams, bigrams = _counts(answers, "total")
        context, two, one = _estimates(grams, unigrams, bigrams, tokens)
        w = weights[_bucket(context)]
        model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (distinct + 1))
        seen = unigrams[grams.place[grams.token]]
        base = np.log10((seen + 1) / (tokens + distinct + 1))
        n = np.asarray(own["tokens"][0].as_py(), np.int64)
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        return pa.table(
            {
                "doc_id": pa.array(own["doc_ids"][0].as_py(), pa.int64()),
                "kind": pa.array([own["kind"][0].as_py()] * len(n), pa.int32()),
                "n_tokens": pa.array(n),
                "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), at)),
                "train_tokens": pa.array([tokens] * len(n), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(model, at)),
            }
        )

    return score


def score(docs: DataFrame, train: Column, held: Column) -> DataFrame:
    """Scores of every row of docs(doc_id, text): kind (COUNTED, HELD or OTHER),
    n_tokens, n_known, train_tokens, base_score, score.

    train marks training rows, and held those among them that fit the weights.
    Null and empty texts have one token, the end. Rows that repeat an id are
    scored each. Without training rows nothing is known and the uniform estimate
    is 1; without held rows the weights are 0.6, 0.3 and 0.1.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    kind = F.when(~F.coalesce(train, F.lit(False)), OTHER).when(F.coalesce(held, F.lit(False)), HELD).otherwise(COUNTED)
    segments = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind")).mapInArrow(_segments, _SEGMENT_DDL))
    size = segments.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()[0]["n"] or 0
    bits = max(4, int(size // PARTITION_GRAMS).bit_length())
    asked = segments.select("segment", "kind", "vocabulary", "codes").mapInArrow(_ask(bits), _ASK_DDL)
    answers = common.stored(asked.groupBy("size", "part").applyInArrow(_answer, _ANSWER_DDL))
    sums = {r["size"]: r for r in answers.filter("segment IS NULL").groupBy("size").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(4)]).collect()}
    tokens, distinct, counted_tokens, counted_distinct = (sums[1][f"n{i}"] for i in range(4)) if 1 in sums else (0, 0, 0, 0)
    answered = answers.filter("segment IS NOT NULL")
    held_rows = segments.filter(F.col("kind") == HELD)
    grid = (
        held_rows.groupBy("segment")
        .cogroup(answered.filter("counted IS NOT NULL").select("segment", "size", "part", "counted").groupBy("segment"))
        .applyInArrow(_histogram(counted_tokens, counted_distinct), "bucket int, two int, one int, n long")
        .groupBy("bucket", "two", "one")
        .agg(F.sum("n").alias("n"))
    )
    cells = np.array([tuple(r) for r in grid.collect()], np.int64).reshape(-1, 4)
    weights = maximise(cells)
    return segments.groupBy("segment").cogroup(answered.select("segment", "size", "part", "total").groupBy("segment")).applyInArrow(_score(tokens, distinct, weights), _SCORE_DDL)


def op10_ngramlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = common.fold("doc_id", 7)
    found = score(common.table(spark, sf_dir, "documents"), fold != 2, fold == 3)
    return found.select("doc_id", (F.col("kind") == OTHER).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
