"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents into segments of bounded size. Within a segment
every term has one row of ascending positions; document k's words are numbered
consecutively and one number is left free between documents, so no phrase runs
across two of them. A row without a term heads each segment and holds the
documents. The index is stored in the shared folder and searched segment by
segment: a phrase's offset-adjusted lists are intersected from the term that is
rarest in the whole corpus, so most phrases end at the first or second list.

Only the stated query set (the benchmark) is sent to the tasks. It is cut into
blocks of at most BLOCK_WORDS words, measured before sending, and the stored
index is searched once for each block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SEGMENT_BYTES = 8 << 20
BLOCK_WORDS = 1_000_000

INDEX_SCHEMA = "segment long, term binary, n int, positions array<int>, doc_ids array<long>"
_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("positions", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])


def _segment(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    data, offsets = common.text_bytes(batch.column("text"))
    flat, at, bounds = common.words(data, offsets, common.ALNUM)
    codes, terms = common.coded(flat, at)
    docs = len(bounds) - 1
    starts = bounds + np.arange(docs + 1)
    position = (np.arange(len(codes)) + np.repeat(np.arange(docs), np.diff(bounds))).astype(np.int32)
    n = np.bincount(codes, minlength=len(terms)).astype(np.int32)
    lists = np.concatenate([starts.astype(np.int32), position[np.argsort(codes, kind="stable")]])
    ends = np.concatenate([[0, docs + 1], docs + 1 + np.cumsum(n)]).astype(np.int32)
    rows = len(terms) + 1
    ids = np.full(rows + 1, docs, np.int32)
    ids[0] = 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, number, np.int64)),
            pa.concat_arrays([pa.nulls(1, pa.binary()), terms.cast(pa.binary())]),
            pa.array(np.concatenate([[docs], n]).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(lists)),
            pa.ListArray.from_arrays(pa.array(ids), common.joined(batch.column("doc_id")).cast(pa.int64())),
        ],
        schema=_ARROW,
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in common.slices(batch, "text", SEGMENT_BYTES):
            out = _segment(part, number)
            number += 1
            for at in range(0, out.num_rows, 20_000):
                yield out.slice(at, 20_000)


def build_index(docs: DataFrame) -> DataFrame:
    """Store and return the positional index of docs(doc_id, text).

    One row for each (segment, term) with its positions, and one row with a
    null term for each segment: doc_ids and, as positions, where each document
    begins. Null text has no words. Repeated rows are separate documents.
    """
    return common.stored(docs.select("doc_id", "text").mapInArrow(_index, INDEX_SCHEMA))


def term_counts(index: DataFrame, terms: Iterable[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole corpus of the given query terms."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in terms] or [(None,)], "term binary")
    found = index.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.toLocalIterator()}


class Phrases:
    """A block of query phrases, each a list of terms, ready for any segment."""

    def __init__(self, phrases: list[list[bytes]], counts: dict[bytes, int]):
        distinct = sorted({t for p in phrases for t in p})
        number = {t: i for i, t in enumerate(distinct)}
        self.terms = pa.array(distinct, pa.binary())
        self.lengths = np.array([len(p) for p in phrases], np.int32)
        self.matrix = np.full((len(phrases), max(self.lengths, default=1)), -1, np.int32)
        for i, p in enumerate(phrases):
            self.matrix[i, : len(p)] = [number[t] for t in p]
        rare = np.array([counts.get(t, 0) for t in distinct] + [1 << 62])
        self.order = np.argsort(rare[self.matrix], axis=1, kind="stable").astype(np.int16)

    def postings(self, group: pa.Table) -> tuple[np.ndarray, list[int], list[np.ndarray | None]]:
        """Document starts, ids and the position lists by term number."""
        import pyarrow.compute as pc

        head = group.filter(pc.is_null(group["term"])).slice(0, 1)
        rest = group.filter(pc.is_valid(group["term"]))
        starts = np.asarray(common.joined(head["positions"]).flatten())
        ids = common.joined(head["doc_ids"]).flatten().to_pylist()
        where = pc.index_in(rest["term"], self.terms)
        lists: list[np.ndarray | None] = [None] * len(self.terms)
        column = common.joined(rest["positions"])
        values, at = np.asarray(column.values), np.asarray(column.offsets)
        for row, term in enumerate(where.to_pylist()):
            if term is not None:
                lists[term] = values[at[row] : at[row + 1]]
        return starts, ids, lists

    def exact(self, lists: list[np.ndarray | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase, starts of its occurrences), rarest term first."""
        present = np.array([x is not None for x in lists] + [True])
        for i in np.flatnonzero(present[self.matrix].all(axis=1)):
            order, row = self.order[i, : self.lengths[i]], self.matrix[i]
            starts = lists[row[order[0]]] - np.int32(order[0])
            for o in order[1:]:
                other, want = lists[row[o]], starts + np.int32(o)
                at = np.searchsorted(other, want)
                at[at == len(other)] = 0
                starts = starts[other[at] == want]
                if not len(starts):
                    break
            else:
                yield int(i), starts

    def near(self, lists: list[np.ndarray | None], starts: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase, left ends of spans of at most `slop` words that hold all its terms in any order)."""
        present = np.array([x is not None for x in lists] + [True])
        for i in np.flatnonzero(present[self.matrix].all(axis=1)):
            order, row = self.order[i, : self.lengths[i]], self.matrix[i]
            rare = lists[row[order[0]]]
            left = np.unique(np.concatenate([lists[t] for t in np.unique(row[: self.lengths[i]])]))
            at = np.searchsorted(rare, left)
            left = left[(at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] - left < slop)]
            right = left.copy()
            for o in order:
                other = lists[row[o]]
                at = np.searchsorted(other, left)
                right = np.maximum(right, np.where(at < len(other), other[np.minimum(at, len(other) - 1)], np.iinfo(np.int32).max))
            same = np.searchsorted(starts, left, side="right") == np.searchsorted(starts, right, side="right")
            left = left[same & (right - left < slop)]
            if len(left):
                yield int(i), left


def search(index: DataFrame, phrases: list[list[str]], slop: int | None = None) -> DataFrame:
    """Occurrences of phrases: doc_id, phrase (its number), position (in words).

    Without slop the phrase's words stand consecutively; with it all of them
    lie within `slop` words, in any order. Phrases without words match nothing.
    """
    spark = index.sparkSession
    given = [[t.encode() for t in p] for p in phrases]
    counts = term_counts(index, {t for p in given for t in p})
    block = spark.sparkContext.broadcast((Phrases([p for p in given if p], counts), [i for i, p in enumerate(given) if p]))

    def find(group: pa.Table) -> pa.Table:
        query, number = block.value
        starts, ids, lists = query.postings(group)
        out = {"doc_id": [], "phrase": [], "position": []}
        for i, hits in query.exact(lists) if slop is None else query.near(lists, starts, slop):
            docs = np.searchsorted(starts, hits, side="right") - 1
            out["doc_id"] += [ids[d] for d in docs]
            out["phrase"] += [number[i]] * len(hits)
            out["position"] += (hits - starts[docs]).tolist()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("phrase", pa.int32()), ("position", pa.int64())]))

    return _wanted(index, {t for p in given for t in p}).groupBy("segment").applyInArrow(find, "doc_id long, phrase int, position long")


def _wanted(index: DataFrame, terms: set[bytes]) -> DataFrame:
    """Segment heads and the rows of the given terms."""
    wanted = index.sparkSession.createDataFrame([(bytearray(t),) for t in terms] or [(None,)], "term binary")
    rows = index.join(F.broadcast(wanted.withColumnRenamed("term", "wanted_")), F.col("term") == F.col("wanted_"), "left")
    return rows.filter(F.col("term").isNull() | F.col("wanted_").isNotNull()).drop("wanted_")


def _item_words(text: str | None) -> list[bytes]:
    data, offsets = common.text_bytes(pa.array([text], pa.string()))
    flat, at, _ = common.words(data, offsets, common.ALNUM)
    raw = flat.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def windows(items: Iterable[tuple[object, str | None]], size: int) -> dict[tuple[bytes, ...], set[str]]:
    """Windows of `size` consecutive words (a shorter item whole) and the items that have
    each; a null item has windows and no name."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        found = _item_words(text)
        for i in range(max(1, len(found) - size + 1) if found else 0):
            own = out.setdefault(tuple(found[i : i + size]), set())
            if item is not None:
                own.add(str(item))
    return out


def _blocks(bench: DataFrame) -> Iterator[list]:
    """Rows of the benchmark, in blocks of bounded size."""
    block, held = [], 0
    for row in bench.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "") // 4 + 1
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    yield block


def _hits(index: DataFrame, block: list, size: int) -> DataFrame:
    """For every document: doc_id, its place in the index, n_words, hit word positions, items."""
    found = windows(block, size)
    phrases = sorted(found)
    terms = {t for p in phrases for t in p}
    query = index.sparkSession.sparkContext.broadcast((Phrases([list(p) for p in phrases], term_counts(index, terms)), [sorted(found[p]) for p in phrases]))

    def find(group: pa.Table) -> pa.Table:
        sought, items = query.value
        starts, ids, lists = sought.postings(group)
        edge = np.zeros(int(starts[-1]) + 1, np.int32)
        named: dict[int, set[str]] = {}
        for i, hits in sought.exact(lists):
            np.add.at(edge, hits, 1)
            np.add.at(edge, hits + sought.lengths[i], -1)
            for d in np.unique(np.searchsorted(starts, hits, side="right") - 1).tolist():
                named.setdefault(d, set()).update(items[i])
        covered = np.flatnonzero(np.cumsum(edge) > 0)
        cut = np.searchsorted(covered, starts)
        n = len(ids)
        return pa.table(
            {
                "segment": pa.repeat(pa.scalar(group["segment"][0].as_py(), pa.int64()), n),
                "ordinal": pa.array(np.arange(n), pa.int32()),
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(starts) - 1, pa.int64()),
                "hit": pa.array([covered[cut[d] : cut[d + 1]] - starts[d] for d in range(n)], pa.list_(pa.int32())),
                "items": pa.array([sorted(named.get(d, ())) for d in range(n)], pa.list_(pa.string())),
            }
        )

    return _wanted(index, terms).groupBy("segment").applyInArrow(find, "segment long, ordinal int, doc_id long, n_words long, hit array<int>, items array<string>")


def contamination(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and the lists behind them: items (ids as strings), hit (word numbers).

    Null or empty text has no words and is clean. Benchmark rows without
    words have no windows; those without id hit words and are not listed; rows that repeat an item_id count as one item. Rows
    that repeat a doc_id are judged one by one. With an empty benchmark every
    document is clean.
    """
    common.prepare(docs.sparkSession)
    index = build_index(docs)
    parts = [_hits(index, block, size) for block in _blocks(bench)]
    found = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            found = found.unionByName(more)
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged("hit"), merged("items"))
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "hit",
        "items",
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("hit", "items")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
