"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its 5-word shingles. Documents with equal sets are one
node. A node's MinHash values are cut into bands for candidates, and folded into
a bitmap in which every value toggles one bit: from the number of ones in the
XOR of two such bitmaps the similarity follows closely where it is high, so most
false candidates end there. The rest are confirmed on the full shingle sets.

At similarity 0.85, BANDS bands of ROWS values miss a pair with probability
(1 - 0.85**5)**26, about 2e-7. The bitmaps fold VALUES values, of which the bands
take the first; at 0.85 their estimate has a standard deviation of 0.014, and the
test lets pass what it puts at SKETCH_LEAST or more, over five of these below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

WORDS = 5
PERCENT = 85
ROWS, BANDS = 5, 26
VALUES = 512
SKETCH_LONGS = 16
SKETCH_LEAST = 0.77
SLICE_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(column) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles."""
    data, offsets = common.text_bytes(column)
    flat, at, bounds = common.words(data, offsets, common.NONSPACE)
    codes, distinct = common.coded(flat, at)
    word = common.hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        own = word[start:end]
        size = min(WORDS, len(own))
        if not size:
            yield np.zeros(0, np.uint64)
            continue
        value = np.full(len(own) - size + 1, size, np.uint64)
        for k in range(size):
            value = common.mixed(value * _STEP + own[k : len(own) - size + 1 + k])
        yield np.unique(value)


def minima(found: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set of shingle hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        part = _A[:, None] * x[i : i + 512]
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of the values, each with its number."""
    bits = SKETCH_LONGS * 64
    place = common.mixed(values.astype(np.uint64) << np.uint64(16) | np.arange(VALUES, dtype=np.uint64)) % np.uint64(bits)
    odd = (np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def bands(values: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in values[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = common.mixed(key * _STEP + column)
    return key.view(np.int64)


def most_ones(similarity: float) -> int:
    """Ones expected in the XOR of two bitmaps of sets this similar."""
    bits = SKETCH_LONGS * 64
    return int(bits / 2 * (1 - np.exp(-4 * VALUES * (1 - similarity) / bits)))


_DDL = "doc_id long, n_shingles long, node binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH_LONGS))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", SLICE_BYTES):
            n, nodes, keys, sketch = [], [], [], []
            for found in shingles(part.column("text")):
                n.append(len(found))
                if not len(found):
                    nodes.append(None)
                    keys.append(None)
                    sketch.append(np.zeros(SKETCH_LONGS, np.int64))
                    continue
                whole = np.array([found.sum(), common.mixed(found + _STEP).sum() ^ np.uint64(len(found))], np.uint64)
                nodes.append(whole.tobytes())
                values = minima(found)
                keys.append(bands(values))
                sketch.append(odd_sketch(values))
            sketches = np.array(sketch, np.int64).reshape(-1, SKETCH_LONGS)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(sketches[:, i]) for i in range(SKETCH_LONGS))],
                names=["doc_id", "n_shingles", "node", "bands", *(f"s{i}" for i in range(SKETCH_LONGS))],
            )


def near(a: str, b: str) -> Column:
    """What lengths and bitmaps leave possible."""
    n_a, n_b = F.col(f"n{a}"), F.col(f"n{b}")
    ones = sum((F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(1, SKETCH_LONGS)), F.bit_count(F.col(f"s0{a}").bitwiseXOR(F.col(f"s0{b}"))))
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (ones <= most_ones(SKETCH_LEAST))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough; rows come ordered by a."""
    last_id, last = None, None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        for part_at in range(0, batch.num_rows, 256):
            other = list(shingles(batch.column("text_b").slice(part_at, 256)))
            for k, found in enumerate(other):
                i = part_at + k
                if a[i] != last_id or batch.column("text_a")[i] != last[1]:
                    last_id, last = a[i], (next(shingles(batch.column("text_a").slice(i, 1))), batch.column("text_a")[i])
                own = last[0]
                both = len(np.intersect1d(own, found, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= PERCENT * (len(own) + len(found) - both)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[keep], pa.int64()), pa.array(np.array(b)[keep], pa.int64())], names=["a", "b"])


def _one_document(signed: DataFrame, placed: DataFrame) -> DataFrame:
    """placed(node, component) with the components joined that one id has texts in."""
    several = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("one"), F.max("node").alias("other")).filter("one != other")
    several = common.stored(several.select("doc_id"))
    if several.isEmpty():
        return placed
    # a component is named by the least id in it, so an id stands for its own component too
    links = signed.join(several, "doc_id").join(placed, "node").select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
    joined = graph.components(links).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    return common.stored(placed.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_shingles, component_id, kept.

    Texts that are null, empty or without words have no shingles and are linked
    with nothing; neither are rows with a null doc_id (their component_id is
    null, they are kept). Rows that repeat an id and a text share their result;
    rows that repeat an id with other texts are one document, linked by any of them:
    all its rows with words have one component.
    """
    common.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.stored(texts.mapInArrow(_sign, _DDL))
    whole = ["n_shingles", "bands", *(f"s{i}" for i in range(SKETCH_LONGS))]
    nodes = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in whole])
    nodes = common.stored(nodes)
    records = nodes.select("id", F.col("n_shingles").alias("n"), "bands", *(f"s{i}" for i in range(SKETCH_LONGS)))

    own: list[DataFrame] = []

    def verified(pairs: DataFrame, ids: DataFrame) -> DataFrame:
        """Merge joins at every size: what is joined grows with the documents."""
        if not own:
            own.append(common.stored(texts.hint("merge").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")))
        one, other = (own[0].select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge") for c in "ab")
        return pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long").distinct()

    found = graph.grouped(records, F.col("bands"), near, verified)
    placed = nodes.select("node", "id").join(found, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    placed = _one_document(signed, common.stored(placed))
    out = signed.select("doc_id", "n_shingles", "node").join(placed, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 5 + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * m >= 85 * (na.n + nb.n - m)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
