"""A kept search index: immutable segments of postings in blocks, with deletions.

Each append writes a segment, of which a manifest then takes note. Terms are dealt to
buckets by their hash, so a query reads the files of its own words' buckets; within a
bucket rows are sorted by term. A row is a block of at most BLOCK postings of one term
within a span of ids, with the largest term frequency and the least document length in
it: no posting of the block scores more than these two would. Spans bound what one group
holds, however frequent a term is.

The best k are found by these bounds. Spans are taken by their summed bounds until they
hold enough rows; their k-th best score is a threshold, and of the rest only blocks are
read that, with the best of the other words in the span, can reach it. A row of which a
block is passed over scores less than the threshold, so the result is exact.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.operators import search
from missive.operators.store import Conflict
from missive.session import Files

BUCKETS, BLOCK, SPAN = 64, 128, 1 << 16
#: Spans that are named in a filter of the second read; more are joined.
NAMED = 1000
#: Spans that the first read takes at most, best bounds first.
FIRST = 64
_BLOCKS = "term string, span long, block int, n int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>, positions array<array<int>>, segment string, bucket int"
_DOCS = "id long, dl int, segment string"
_GONE = "id long, segment string"


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _weight(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * dl / avgdl))


def _words(tree) -> tuple[set[str], set[str]]:
    """Words and prefixes that an expression asks for."""
    if isinstance(tree, search.Op):
        (a, p), (b, q) = _words(tree.left), _words(tree.right)
        return a | b, p | q
    phrases = [tree] if isinstance(tree, search.Phrase) else list(tree.phrases)
    words = {w for p in phrases for i, w in enumerate(p.words) if not (p.prefix and i == len(p.words) - 1)}
    return words, {p.words[-1] for p in phrases if p.prefix and p.words}


def _plain(tree) -> bool:
    """Whether all is single words, whose postings bound their scores."""
    if isinstance(tree, search.Op):
        return _plain(tree.left) and _plain(tree.right)
    return isinstance(tree, search.Phrase) and len(tree.words) == 1 and not tree.prefix and not tree.first


class Index:
    """An index folder. Ids of rows that are not deleted must be their own."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN, block: int = BLOCK):
        self.spark, self.path, self.span, self.block, self.files = spark, path.rstrip("/"), span, block, Files(spark)

    # -------------------------------------------------------- state

    def state(self) -> dict:
        names = sorted(n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json"))
        if not names:
            return {"version": 0, "segments": [], "gone": {}, "docs": 0, "words": 0}
        return json.loads(self.files.read(f"{self.path}/manifest/{names[-1]}"))

    def _commit(self, before: dict, **after) -> None:
        version = before["version"] + 1
        if not self.files.publish(f"{self.path}/manifest/{version:012}.json", json.dumps(before | after | {"version": version})):
            raise Conflict(f"version {version} of {self.path} is there already")

    def _table(self, name: str, ddl: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], ddl)
        home = f"{self.path}/{name}"
        return self.spark.read.schema(ddl).option("basePath", home).parquet(*[f"{home}/segment={s}" for s in segments])

    def _living(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (id, segment) that no later deletion took."""
        gone = [g for own in state["gone"].values() for g in own]
        if not gone:
            return rows
        # a deletion names the segments that it found, so that the id may come again later
        pairs = self.spark.createDataFrame([(s, g) for s, own in state["gone"].items() for g in own], "of string, deletion string")
        deleted = self._table("gone", _GONE, sorted(set(gone))).withColumnRenamed("segment", "deletion").join(F.broadcast(pairs), "deletion")
        return rows.join(deleted.select("id", F.col("of").alias("segment")), ["id", "segment"], "left_anti")

    # -------------------------------------------------------- writes

    def append(self, documents: DataFrame, key: str = "id", body: str = "body") -> None:
        """Index rows with new ids."""
        before = self.state()
        tokens = documents.select(F.col(key).cast("long").alias("id"), search.terms_of(F.col(body)).alias("terms")).persist()
        try:
            docs = tokens.select("id", F.size("terms").alias("dl"))
            each = tokens.select("id", F.size("terms").alias("dl"), F.posexplode("terms").alias("at", "term"))
            found = each.groupBy("term", "id", "dl").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
            segment = self._written(found, docs)
        finally:
            tokens.unpersist()
        n, words = self._size([segment])
        self._commit(before, segments=[*before["segments"], segment], docs=before["docs"] + n, words=before["words"] + words)

    def _written(self, found: DataFrame, docs: DataFrame) -> str:
        segment = uuid.uuid4().hex
        own = W.partitionBy("term", "span").orderBy("id")
        placed = found.withColumn("span", F.floor(F.col("id") / self.span)).withColumn("block", F.floor((F.row_number().over(own) - 1) / self.block).cast("int"))
        packed = placed.groupBy("term", "span", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("id", "tf", "dl", "positions"))).alias("rows"))
        columns = [F.col(f"rows.{c}").alias(name) for c, name in (("id", "ids"), ("tf", "tfs"), ("dl", "dls"), ("positions", "positions"))]
        blocks = packed.select("term", "span", "block", "n", "max_tf", "min_dl", *columns, (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int").alias("bucket"))
        blocks = blocks.repartition("bucket", "span").sortWithinPartitions("bucket", "term", "span", "block")
        blocks.write.partitionBy("bucket").parquet(f"{self.path}/blocks/segment={segment}")
        docs.write.parquet(f"{self.path}/docs/segment={segment}")
        return segment

    def _size(self, segments: list[str]) -> tuple[int, int]:
        row = self._table("docs", _DOCS, segments).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).collect()[0]
        return row["n"], row["words"]

    def delete(self, ids: DataFrame) -> None:
        """Take rows of ids(id) out of what searches find and count."""
        before = self.state()
        lost = self._living(self._table("docs", _DOCS, before["segments"]), before).join(ids.select("id").distinct(), "id", "left_semi").persist()
        try:
            row = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).collect()[0]
            deletion = uuid.uuid4().hex
            lost.select("id").write.parquet(f"{self.path}/gone/segment={deletion}")
        finally:
            lost.unpersist()
        gone = {s: [*before["gone"].get(s, []), deletion] for s in before["segments"]}
        self._commit(before, gone=gone, docs=before["docs"] - row["n"], words=before["words"] - row["words"])

    def merge(self, at_least: int = 2) -> bool:
        """Make one segment of all, without deleted rows, where there are so many. Readers go
        on with the segments that they have; if a writer commits meanwhile it is a Conflict
        and nothing has changed."""
        before = self.state()
        if len(before["segments"]) < at_least:
            return False
        docs = self._living(self._table("docs", _DOCS, before["segments"]), before).select("id", "dl")
        segment = self._written(self._postings(self._table("blocks", _BLOCKS, before["segments"]), before), docs)
        self._commit(before, segments=[segment], gone={})
        return True

    def vacuum(self) -> None:
        """Remove what the newest manifest does not name. Not while someone writes or reads of old."""
        state = self.state()
        kept = {*state["segments"], *(g for own in state["gone"].values() for g in own)}
        for name in ("blocks", "docs", "gone"):
            for folder in self.files.names(f"{self.path}/{name}"):
                if folder.removeprefix("segment=") not in kept:
                    self.files.remove(f"{self.path}/{name}/{folder}")

    # -------------------------------------------------------- reads

    def blocks(self, tree, state: dict | None = None) -> DataFrame:
        """The blocks of an expression's words, from the files of their buckets; a prefix may
        be in any of them."""
        state = state or self.state()
        words, prefixes = _words(tree)
        rows = self._table("blocks", _BLOCKS, state["segments"])
        if not prefixes:
            rows = rows.filter(F.col("bucket").isin(sorted({_bucket(w) for w in words})))
        tests = [F.col("term").isin(sorted(words))] + [F.col("term").startswith(p) for p in sorted(prefixes)]
        return rows.filter(reduce(lambda a, b: a | b, tests))

    def _postings(self, blocks: DataFrame, state: dict) -> DataFrame:
        each = blocks.select("segment", "term", F.inline(F.arrays_zip("ids", "tfs", "dls", "positions")).alias("id", "tf", "dl", "positions"))
        return self._living(each, state).drop("segment")

    def postings(self, tree) -> DataFrame:
        """(term, id, tf, dl, positions) of an expression's words."""
        state = self.state()
        return self._postings(self.blocks(tree, state), state)

    def lengths(self) -> DataFrame:
        state = self.state()
        return self._living(self._table("docs", _DOCS, state["segments"]), state).select("id", "dl")

    def average(self, state: dict | None = None) -> float:
        state = state or self.state()
        return state["words"] / state["docs"] if state["words"] else 1.0

    def candidates(self, tree, k: int, state: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(blocks that the best k of a plain expression can be in, headers of all blocks of
        its words); both have segment, term, span and block."""
        state = state or self.state()
        rows = self.blocks(tree, state)
        idf, avgdl = self._idf(rows, state), self.average(state)
        scoring = {p.words[0] for p in search._phrases(tree)}
        weight = F.create_map(*[F.lit(x) for w in sorted(scoring) for x in (w, idf.get(w, 0.0))])
        # words after a NOT score nothing, and their blocks are always read
        bound = F.coalesce(weight[F.col("term")] * _weight(F.col("max_tf"), F.col("min_dl"), avgdl), F.lit(0.0))
        heads = rows.select("segment", "term", "span", "block", "n", bound.alias("bound"), F.col("term").isin(sorted(scoring)).alias("scores"))
        by_term = heads.groupBy("span", "term").agg(F.max("bound").alias("best"), F.sum(F.when(F.col("scores"), F.col("n"))).alias("n"))
        spans = by_term.groupBy("span").agg(F.sum("best").alias("best"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        first, rows_there = [], 0
        for r in spans.orderBy(F.desc("best"), "span").limit(FIRST).collect():
            if rows_there >= 2 * k:
                break
            first.append(r["span"])
            rows_there += r["n"]
        tried = self._scored(rows.filter(F.col("span").isin(first)), tree, idf, avgdl, state).orderBy("score", "id").limit(k).collect()
        least = -tried[-1]["score"] * (1 - 1e-9) if len(tried) == k else 0.0
        reach = heads.join(spans.withColumnRenamed("best", "all").drop("n"), "span").join(by_term.select("span", "term", "best"), ["span", "term"])
        kept = reach.filter(F.col("span").isin(first) | (F.when(F.col("scores"), F.col("bound") + F.col("all") - F.col("best")).otherwise(F.col("all")) >= least))
        return kept.select("segment", "term", "span", "block", "n"), heads

    def top(self, tree, k: int) -> DataFrame:
        """(id, score) of the best k rows, best first, ties by id."""
        state = self.state()
        if not state["segments"]:
            return self.spark.createDataFrame([], "id long, score double")
        if not _plain(tree):
            found = self._postings(self.blocks(tree, state), state)
            stats = self.spark.createDataFrame([(state["docs"], self.average(state))], "n long, avgdl double")
            return search.scores(found, None, search.matches(found, tree), tree, stats).orderBy("score", "id").limit(k)
        kept, _ = self.candidates(tree, k, state)
        rows = self.blocks(tree, state)
        spans = [r["span"] for r in kept.select("span").distinct().limit(NAMED + 1).collect()]
        if len(spans) <= NAMED:
            rows = rows.filter(F.col("span").isin(spans))
        rows = rows.join(kept.select("segment", "term", "span", "block"), ["segment", "term", "span", "block"], "left_semi")
        return self._scored(rows, tree, self._idf(self.blocks(tree, state), state), self.average(state), state).orderBy("score", "id").limit(k)

    def _idf(self, blocks: DataFrame, state: dict) -> dict[str, float]:
        """Weights of an expression's words, from the headers; with deletions, from the ids."""
        if any(state["gone"].values()):
            each = self._living(blocks.select("segment", "term", F.explode("ids").alias("id")), state).groupBy("term").agg(F.count("*").alias("df"))
        else:
            each = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        n = state["docs"]
        idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(search.LEAST_IDF))
        return {r["term"]: r["idf"] for r in each.select("term", idf.alias("idf")).collect()}  # a row for each word of the query

    def _scored(self, blocks: DataFrame, tree, idf: dict[str, float], avgdl: float, state: dict) -> DataFrame:
        rows = self._postings(blocks.drop("bucket"), state)
        words = sorted({p.words[0] for p in search._phrases(tree)} & set(idf))
        if not words:
            return rows.select("id", F.lit(0.0).alias("score")).limit(0)
        weight = F.create_map(*[F.lit(x) for w in words for x in (w, idf[w])])
        own = rows.filter(F.col("term").isin(words)).join(search.matches(rows, tree), "id", "left_semi")
        return own.groupBy("id").agg((-F.sum(weight[F.col("term")] * _weight(F.col("tf"), F.col("dl"), avgdl))).alias("score"))
