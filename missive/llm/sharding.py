"""Shards of equal row counts that keep linked documents together, by balanced label
propagation.

Rows with an equal value of a link column are linked. Every linked row begins with the
shard that a hash deals it. In each round groups count their rows by shard, each group
proposes the open shard where most of its rows are (a group beyond that shard's room
proposes as many as it fills), and a row that has more partners there than where it is
asks to move. A shard grants moves as its room allows, those of greatest gain first,
told apart by a histogram of gains and hash slots of groups, so that no shard's wishes are ever
sorted or gathered. Rounds end when nobody moves. Rows without links then fill each
shard up to its quota, and rows beyond a quota are dealt with them: counts differ by one
at most, whatever the rounds did.

A group is counted before it is shuffled and split where it is joined, so one that
holds a third of all rows is no task of its own. Null links link nothing; repeated rows
are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS = 40
ROUNDS = 12
SLOTS = 64
#: A row's place in its stored partition; the partition's number stands above it.
PLACE_BITS = 33


@dataclass
class _Quota:
    """Rows that each shard may hold, and those with links that it holds."""

    most: np.ndarray
    load: np.ndarray
    open: np.ndarray
    closed: bool = False  # whether a shard closed in the last round

    def room(self) -> np.ndarray:
        return np.where(self.open, np.maximum(self.most - self.load, 0), 0)


def _members(rows: DataFrame, links: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, group, first) of the rows that share a link with another, where first marks one
    membership of each row; and the stored groups. Joins are with stored tables throughout,
    so that a group's rows are dealt to several tasks where they are many."""
    each = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("link"), F.col(c).cast("string").alias("value"))) for i, c in enumerate(links)])
    asked = rows.select("node", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("at")).select("node", F.md5(F.concat_ws(":", "at.link", "at.value")).alias("group"))
    shared = common.stored(asked.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group"))
    found = asked.join(shared, "group", "left_semi")
    if len(links) == 1:
        return found.withColumn("first", F.lit(True)), shared
    return found.withColumn("first", F.row_number().over(W.partitionBy("node").orderBy("group")) == 1), shared


def _proposals(state: DataFrame, room: np.ndarray) -> DataFrame:
    """(group, cells, targets, all): a group's rows by shard, most first, the shards it
    proposes, each up to a running total of room, until its rows fit, and their number."""
    cells = state.groupBy("group", "shard").agg(F.count("*").alias("n"))
    # ties differ by group, or else the first shards would fill first
    cell = F.struct((-F.col("n")).alias("order"), F.xxhash64("group", "shard").alias("tie"), "shard", "n")
    packed = cells.groupBy("group").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("n").alias("n"))  # one entry for each shard at most
    rooms = _literal(room)
    free = F.filter("cells", lambda c: F.get(rooms, c["shard"]) > 0)
    start = F.array().cast("array<struct<shard: int, n: bigint, upto: bigint>>")

    def take(done: Column, c: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["upto"], F.lit(0).cast("long"))
        upto = before + F.get(rooms, c["shard"]) + c["n"]  # rows that are there already need no room
        return F.when(before >= F.col("n"), done).otherwise(F.concat(done, F.array(F.struct(c["shard"].alias("shard"), c["n"].alias("n"), upto.alias("upto")))))

    return packed.select("group", "cells", F.aggregate(free, start, take).alias("targets"), F.col("n").alias("all"))


def _wishes(state: DataFrame, proposals: DataFrame, several: bool) -> DataFrame:
    """state with target (null: stays) and gain, the partners more that a row has there."""
    met = state.join(proposals, "group")
    at = F.pmod(F.xxhash64("node"), F.least("all", F.get("targets", F.size("targets") - 1)["upto"]))  # deals a large group's rows out over its targets
    chosen = F.get(F.filter("targets", lambda t: t["upto"] > at), F.lit(0))
    here = F.get(F.filter("cells", lambda c: c["shard"] == F.col("shard")), F.lit(0))["n"] - 1
    stays = (F.size("targets") == 0) | F.exists("targets", lambda t: t["shard"] == F.col("shard"))
    # rows of a group that fits one shard move together or not at all
    lot = F.when((F.size("targets") > 1) | F.lit(several), F.xxhash64("node")).otherwise(F.xxhash64("group"))
    wished = met.select("node", "group", "first", "shard", here.alias("hold"), lot.alias("lot"), F.when(~stays, chosen).alias("to"))
    wished = wished.select("node", "group", "first", "shard", "hold", "lot", F.col("to.shard").alias("target"), F.coalesce("to.n", F.lit(0)).alias("pull"))
    if several:
        # a row in several groups takes the target with most partners, less those it leaves
        by = wished.repartition("node").groupBy("node", "target").agg(F.sum("pull").alias("pull"), F.sum("hold").alias("hold"))
        best = by.groupBy("node").agg(F.max_by("target", F.struct("pull", "target")).alias("target"), F.max("pull").alias("pull"), F.sum("hold").alias("hold"))
        wished = state.join(best, "node").withColumn("lot", F.xxhash64("node"))
    gain = F.when(F.col("target").isNotNull() & (F.col("pull") > F.col("hold")), F.col("pull") - F.col("hold"))
    return wished.select("node", "group", "first", "shard", "lot", F.when(gain.isNotNull(), F.col("target")).alias("target"), gain.alias("gain"))


def _grants(wished: DataFrame, quota: _Quota, turn: int) -> tuple[Column, int]:
    """The condition under which a wish is granted, and the number of those."""
    rank = (F.floor(F.log2("gain")) * SLOTS + F.pmod(F.xxhash64("lot", F.lit(turn)), F.lit(SLOTS))).cast("int")
    counts = wished.filter("first AND target IS NOT NULL").groupBy("target", rank.alias("rank")).agg(F.count("*").alias("n")).collect()  # gains by powers of two
    quota.closed = False
    room, least, granted = quota.room(), np.full(len(quota.most), np.iinfo(np.int32).max), 0
    for t in {r["target"] for r in counts}:
        own = sorted(((r["rank"], r["n"]) for r in counts if r["target"] == t), reverse=True)
        total = np.cumsum([n for _, n in own])
        fits = int(np.searchsorted(total, room[t], side="right"))
        if fits:
            least[t] = own[fits - 1][0]
            granted += int(total[fits - 1])
        if fits < len(own) and 2 * (total[fits - 1] if fits else 0) < room[t]:
            quota.open[t], quota.closed = False, True
    bounds = F.array(*[F.lit(int(v)) for v in least])
    return F.col("target").isNotNull() & (rank >= F.get(bounds, F.col("target"))), granted


def _loads(state: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    for r in state.filter("first").groupBy("shard").agg(F.count("*").alias("n")).collect():
        out[r["shard"]] = r["n"]
    return out


def propagate(members: DataFrame, most: np.ndarray, rounds: int, several: bool) -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """Labels (node, shard) of members(node, group, first), how many each shard has, and
    the stored tables that they are read from."""
    shards = len(most)
    tables = [common.stored(members.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(shards)), F.lit(shards)).cast("int")))]
    state = tables[0]
    quota = _Quota(most, _loads(state, shards), np.ones(shards, bool))
    for turn in range(rounds):
        if not quota.room().any():
            break
        proposals = common.stored(_proposals(state, quota.room()))
        wished = common.stored(_wishes(state, proposals, several))
        tables += [proposals, wished]
        granted, n = _grants(wished, quota, turn)
        # a row in several groups has the same wish, gain and hash in each of its memberships
        state = wished.select("node", "group", "first", F.when(granted, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        if not n and not quota.closed:
            break
        quota.load = _loads(state, shards)
    return state.filter("first").select("node", "shard"), quota.load, tables


def numbered(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """rows(node, ...) with a gapless number from 0 within each value of `by`, in the order
    of node: counts of stored partitions are summed up, and rows numbered within each."""
    rows = rows.withColumns({"by": by, "part": F.shiftright("node", PLACE_BITS)})
    counts = rows.groupBy("by", "part").agg(F.count("*").alias("n"))
    before = counts.select("by", "part", F.coalesce(F.sum("n").over(W.partitionBy("by").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("by", "part").orderBy("node"))
    return rows.join(before, ["by", "part"]).withColumn(name, F.col("before") + inside - 1).drop("by", "part", "before")


def shard(docs: DataFrame, links: list[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows of docs with two more columns: shard int, from 0, and slot long, a gapless number
    in the shard. Counts of shards are one apart at most. Rows with an equal non-null value
    in one of the columns `links` are kept together as far as the quotas let them. Columns
    with either name give way."""
    spark = docs.sparkSession
    common.prepare(spark)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    inner = {c: f"keep{i}" for i, c in enumerate(kept)}
    rows = common.stored(docs.select(F.monotonically_increasing_id().alias("node"), *[F.col(c).alias(k) for c, k in inner.items()]))
    total = rows.count()
    most = total // shards + (np.arange(shards) < total % shards)
    members, shared = _members(rows, [inner[c] for c in links])
    labels, load, tables = propagate(members, most, rounds, len(links) > 1)
    placed = common.stored(numbered(rows.join(labels, "node", "left"), F.coalesce("shard", F.lit(-1)), "slot"))
    held = np.minimum(load, most)
    within = F.col("shard").isNotNull() & (F.col("slot") < F.get(_literal(most), F.col("shard")))
    rest = numbered(placed.filter(~within).drop("shard", "slot"), F.lit(0), "number")
    upto = np.cumsum(most - held)
    shard_ = F.size(F.filter(_literal(upto), lambda u: u <= F.col("number")))
    rest = rest.withColumn("shard", shard_).withColumn("slot", F.col("number") - F.get(_literal(upto - most), F.col("shard"))).drop("number")
    common.dropped(rows, shared, *tables)
    return placed.filter(within).unionByName(rest).select(*[F.col(k).alias(c) for c, k in inner.items()], "shard", "slot")


def _literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("same_text"))
    return shard(docs, ["same_text"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
