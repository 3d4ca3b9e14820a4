"""Runs of repeated words, by the runs theorem.

A run is a stretch of words with smallest period q, of REPEATS periods and LEAST words
at least, that cannot be extended on either side. By the runs theorem every run has a
Lyndon root that is the longest Lyndon word at its place, under the order of words or
under the reverse order; with the inverse suffix array these longest words end just
before the next smaller, or next larger, value. Each (place, length of its longest
Lyndon word) is a candidate, which is extended to both sides by longest common
extensions: minima over the LCP array, answered from a sparse table. Texts of a batch
are laid end to end, each closed by a word of its own that is less than all others, so
that one pass of numpy over a batch treats all its texts, and a text of any length is
taken whole.

Null and empty texts, and texts of white space, have no words and no runs; their
collapsed text is ''. Repeated rows are searched each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, REPEATS = 6, 4
#: Bytes of text that are searched together, one text at least.
SLICE = 4 << 20
#: Steps along a chain of smaller values before the rest is found by halving.
CHAIN = 32


class Minima:
    """Sparse table over an array: the least value of any range, in two lookups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of [first, last], both ends inside."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.log2(last - first + 1).astype(np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.levels[k]
            out[own] = np.minimum(table[first[own]], table[last[own] + 1 - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the array's length."""
    n = len(values)
    closed = np.append(values, np.iinfo(values.dtype).min)
    found = np.arange(1, n + 1)
    open_ = np.flatnonzero(closed[found] >= values)
    for _ in range(CHAIN):
        if not len(open_):
            return found
        found[open_] = found[found[open_]]  # all that lies between is no smaller
        open_ = open_[closed[found[open_]] >= values[open_]]
    table = Minima(closed)
    at = found[open_]
    for k in range(len(table.levels) - 1, -1, -1):
        inside = at + (1 << k) <= n + 1
        skip = np.zeros(len(at), bool)
        skip[inside] = table.levels[k][at[inside]] >= values[open_[inside]]
        at[skip] += 1 << k
    found[open_] = at
    return found


class Suffixes:
    """Ranks of all suffixes within their texts, by doubling: only suffixes that are
    still equal to another are sorted again. codes >= 1; closing places hold 0."""

    def __init__(self, codes: np.ndarray, text: np.ndarray):
        self.levels: list[np.ndarray] = []
        keys = text * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(keys, kind="stable")
        n = len(keys)
        ranks = np.empty(n, np.int64)
        fresh = np.append(True, np.diff(keys[order]) != 0)
        ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        left = order[~(fresh & np.append(fresh[1:], True))]
        width = 1
        while len(left):
            self.levels.append(ranks.copy())
            base = ranks[left]
            follow = ranks[left + width]  # a suffix that is equal to another ends no text
            order = np.argsort(base * n + follow)
            left, base, follow = left[order], base[order], follow[order]
            group = np.append(True, np.diff(base) != 0)
            fresh = group | np.append(True, np.diff(follow) != 0)
            at = np.arange(len(left))
            start = np.maximum.accumulate(np.where(group, at, 0))
            ranks[left] = base + np.maximum.accumulate(np.where(fresh, at, 0)) - start
            left = left[~(fresh & np.append(fresh[1:], True))]
            width *= 2
        self.ranks = ranks

    def shared(self) -> Minima:
        """The LCP array, lcp[r] of the suffixes of rank r - 1 and r, as a table of minima."""
        places = np.empty(len(self.ranks), np.int64)
        places[self.ranks] = np.arange(len(self.ranks))
        a, b = places[:-1].copy(), places[1:].copy()
        lcp = np.zeros(len(places), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            lcp[1:][same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        return Minima(lcp)


def _extension(ranks: np.ndarray, lcp: Minima, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(ranks[a], ranks[b]), np.maximum(ranks[a], ranks[b])
    return lcp.least(low + 1, high)


def _candidates(codes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of longest Lyndon words, under either order, whose first words
    come again a period later: a root that begins in a run's first period is followed
    by at least (REPEATS - 2) periods and one word of repetition."""
    n = len(codes)
    out = []
    for values in (ranks, np.where(codes == 0, -n - 1, -ranks)):
        place = np.flatnonzero(codes)
        period = next_smaller(values)[place] - place
        for ahead in range(REPEATS - 1):
            other = np.minimum(place + period + ahead, n - 1)
            same = (codes[place + ahead] == codes[other]) & (codes[other] != 0) & (place + period + ahead < n)
            place, period = place[same], period[same]
        out.append((place, period))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of the texts codes[bounds[t]:bounds[t+1]],
    by text, start and period. Codes are 1 or more."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 4
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    first = bounds[:-1] + np.arange(len(sizes))  # each text is followed by its closing place
    closed = np.zeros(len(text), np.int64)
    closed[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    place, period = _candidates(closed, Suffixes(closed, text).ranks)
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    # extensions are asked for in texts with candidates only
    having = np.unique(text[place])
    inside = np.isin(text, having)
    moved = np.cumsum(inside) - 1
    place, codes_, text_ = moved[place], closed[inside], np.searchsorted(having, text[inside])
    begin = moved[first[having]]
    forward = Suffixes(codes_, text_)
    right = _extension(forward.ranks, forward.shared(), place, place + period)
    enough = right >= (REPEATS - 2) * period + 1
    place, period, right = place[enough], period[enough], right[enough]
    last = begin + sizes[having] - 1
    mirror = lambda at, t: begin[t] + last[t] - at
    words = np.flatnonzero(codes_)
    back = np.zeros_like(codes_)
    back[mirror(words, text_[words])] = codes_[words]
    backward = Suffixes(back, text_)
    left = np.zeros(len(place), np.int64)
    some = np.flatnonzero(place > begin[text_[place]])
    t = text_[place[some]]
    left[some] = _extension(backward.ranks, backward.shared(), mirror(place[some] - 1, t), mirror(place[some] + period[some] - 1, t))
    length = left + period + right
    ok = length >= np.maximum(LEAST, REPEATS * period)
    own = text_[place[ok]]
    found = np.unique(np.stack([having[own], (place - left)[ok] - begin[own], period[ok], length[ok]]), axis=1)
    return found[0], found[1], found[3], found[2]


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period; found: rows of start, length, period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each of some texts."""
    words = [(t or "").encode().split() for t in texts.to_pylist()]  # bytes split at [\x20\x09-\x0D] alone
    bounds = np.cumsum([0, *map(len, words)])
    flat = pa.array([w for own in words for w in own], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    text, start, length, period = runs(codes, bounds)
    at = np.searchsorted(text, np.arange(len(words) + 1))
    structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    collapsed = []
    for t, own in enumerate(words):
        if at[t] < at[t + 1]:
            mine = slice(at[t], at[t + 1])
            keep = _kept(len(own), np.stack([start[mine], length[mine], period[mine]], axis=1))
            own = [own[i] for i in np.flatnonzero(keep)]
        collapsed.append(b" ".join(own).decode())
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), structs).cast(_RUNS), pa.array(collapsed, pa.string())


def find(docs: DataFrame) -> DataFrame:
    """Each row of docs(text, ...) with two more columns: runs, an array of (start,
    length, period) in words by start and period, and collapsed, the words that no run
    holds after its first period, one space between. Columns of docs with either name
    give way, and no text is shuffled."""
    common.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    inner = {c: f"keep{i}_" for i, c in enumerate(kept) if c != "text"} | {"text": "text_"}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text_", SLICE):
                found, collapsed = _searched(part.column("text_"))
                yield pa.RecordBatch.from_arrays([*part.columns, found, collapsed], names=[*part.schema.names, "runs_", "collapsed_"])

    rows = docs.select(*[F.col(c).alias(inner[c]) for c in kept])
    ddl = ", ".join([f"{inner[c]} {docs.schema[c].dataType.simpleString()}" for c in kept] + ["runs_ array<struct<start: long, length: long, period: long>>", "collapsed_ string"])
    return rows.mapInArrow(search, ddl).select(*[F.col(inner[c]).alias(c) for c in kept], F.col("runs_").alias("runs"), F.col("collapsed_").alias("collapsed"))


def repeated(doc_id: Column, text: Column) -> Column:
    """The texts that the contract has searched: of every tenth document, by h =
    crc32(id), the words from a on are its p words after a, again and again. A null id
    changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, n - a)), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text"))
    found = find(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
