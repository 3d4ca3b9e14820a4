"""Links among bucketed records and their connected components, in DataFrame
functions only; both near-duplicate operators use it.

Records that share a bucket key are candidates. `grouped`: a bucket's members are first
compared with its least member only, and the components of the links found are
joined. Where a bucket is then still in several components, the members outside its
largest one are compared with all others: the records' own columns are tested
within the join, and a pair comes out of the least key that it shares only, so what
leaves the join is each possible link once. A large group of copies so costs a
comparison for each member, and no link is lost to the order.

`layered`: an operator has keys of two levels, the second finer. Buckets of FEW members
are compared whole, larger ones with their least member, in one pass over the sorted
keys. Where a larger bucket is then still in several components, up to APART members
outside its largest one are compared with all others, which grows with its size and not
with the square; a bucket with more has a key that many unrelated records share, such as
the words of a phrase, and its members go on to the finer keys. These compare all that
is left, each pair once, so no link is lost to the order there either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Members outside a bucket's largest component that are compared with all of it;
#: more of them take finer keys.
APART = 32
#: Members of a bucket that are compared with each other at once.
FEW = 8


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links(a, b): the least id that it reaches.

    Large-star and small-star steps alternate until the edges no longer change.
    Every step is stored, so lineage stays short.
    """
    edges = common.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = common.stored(least)
        large = common.stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        common.dropped(edges, least)
        least = common.stored(large.groupBy("u").agg(F.min("v").alias("m")))
        over = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.stored(over.unionByName(least.withColumnRenamed("m", "v")).distinct())
        common.dropped(large, least)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).collect()[0]
    return row["n"], row["h"]


def _tested(pairs: DataFrame, records: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs whose records' own columns leave them near."""
    names = [c for c, kind in records.dtypes if c != "id" and not kind.startswith("array")]
    left = records.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = records.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    return pairs.join(left, "a").join(right, "b").filter(near("_a", "_b")).select("a", "b")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(members: DataFrame) -> DataFrame:
    """Of members(key, id, component) the keys in several components: key, main (the largest), apart (members outside it)."""
    sizes = members.groupBy("key", "component").count().groupBy("key")
    sizes = sizes.agg(F.max(F.struct("count", "component")).alias("largest"), F.sum("count").alias("n"))
    return sizes.select("key", F.col("largest.component").alias("main"), (F.col("n") - F.col("largest.count")).alias("apart")).filter("apart > 0")


def _across(here: DataFrame, records: DataFrame, near: Callable[[str, str], Column], keys: Column | None = None) -> DataFrame:
    """Near pairs(a, b) in different components of buckets here(key, id, component, main).
    With keys, those of a record, a pair comes out of the least that it shares."""
    names = [c for c, kind in records.dtypes if c != "id" and not kind.startswith("array")]
    own = here.join(records.select("id", *([] if keys is None else [keys.alias("keys")]), *names), "id")
    if keys is not None:
        names.append("keys")
    one, other = (own.select("key", F.col("main").alias(f"main_{c}"), *[F.col(n).alias(f"{n}_{c}") for n in ("id", "component", *names)]) for c in "ab")
    met = one.filter("component_a != main_a").join(other.drop("main_b"), "key")
    once = (F.col("component_b") == F.col("main_a")) | (F.col("id_a") < F.col("id_b"))
    met = met.filter((F.col("component_a") != F.col("component_b")) & once & near("_a", "_b"))
    if keys is not None:
        met = met.filter(F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))
    pairs = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return pairs if keys is not None else pairs.distinct()


def grouped(records: DataFrame, keys: Column, near: Callable[[str, str], Column], verified: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of all records that are linked to another.

    records(id, ...) is a stored table, and keys its column of bucket keys. near
    takes the suffixes of two records' columns and tests what they show; verified
    takes pairs(a, b), a < b, and ids(id) of all that it may be asked for, now or
    later, and returns the pairs that are links.
    """
    buckets = records.select(F.explode(keys).alias("key"), "id")
    shared = common.stored(buckets.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a < b"))
    # shared keys are the smaller side by far, and unique: hashed, so that the buckets need no sort
    crowd = common.stored(buckets.join(shared.filter("n > 2").select("key", "a").hint("shuffle_hash"), "key"))
    star = shared.filter("n = 2").select("a", "b").unionByName(crowd.filter("id != a").select("a", F.col("id").alias("b"))).distinct()
    asked = star.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).distinct()
    candidates = common.stored(records.join(asked, "id", "left_semi"))
    pairs = common.stored(_tested(star, candidates, near))
    # all that any comparison may ask for, so that texts are read once
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).distinct()
    links = common.stored(verified(pairs, ids))
    common.dropped(pairs)
    found = common.stored(components(links))
    members = common.stored(_placed(crowd.select("key", "id").distinct(), found))
    mixed = common.stored(_mixed(members))
    across = common.stored(_across(members.join(mixed, "key"), candidates, near, keys))
    if not across.isEmpty():
        links = links.unionByName(common.stored(verified(across, ids)))
        common.dropped(found)
        found = common.stored(components(links))
    common.dropped(shared, crowd, members, mixed, across, candidates)
    return found


def _buckets(keyed: DataFrame) -> DataFrame:
    """Of keyed(key, id) the rows whose key another shares: key, id, n (rows of the key)
    and earlier (ids of the key to compare with: all lesser ones, in a bucket of over
    FEW the least only; null for the least)."""
    # most keys stand alone: they go after a sort by the key only, and the rest is sorted by id too
    shared = keyed.select("key", "id", F.count("*").over(Window.partitionBy("key")).alias("n")).filter("n > 1")
    order = Window.partitionBy("key").orderBy("id")
    before = [f"before{i}" for i in range(1, FEW)]
    least = F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = shared.select("key", "id", "n", least.alias("least"), *[F.lag("id", i).over(order).alias(c) for i, c in enumerate(before, 1)])
    earlier = F.when(F.col("id") == F.col("least"), None).when((F.col("n") == 2) | (F.col("n") > FEW), F.array("least")).otherwise(F.array(*before))
    return shared.select("key", "id", "n", earlier.alias("earlier"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found(id, component) after further links(a, b): only components that these join are searched."""
    ends = [found.withColumnsRenamed({"id": c, "component": f"component_{c}"}) for c in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    between = common.stored(between.filter("a != b"))
    if between.isEmpty():
        return found
    roots = common.stored(components(between))
    moved = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    out = found.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    out = common.stored(out.unionByName(roots.join(found, "id", "left_anti")))
    common.dropped(between, roots, found)
    return out


def layered(records: DataFrame, keyed: DataFrame, near: Callable[[str, str], Column], finer: Callable[[DataFrame], DataFrame], closer: Callable[[str, str], Column], verified: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of all records that are linked to another, as grouped: first by
    keyed(key, id), then for members of crowded buckets by finer(ids), which returns their
    records(id, keys, ...) that closer tests as near does the first. Two records that are
    near must share a key of both. A pair comes out of the least key that it shares; if
    that is a small bucket's, it was compared there."""

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def compared(buckets: DataFrame) -> DataFrame:
        return buckets.select(F.explode("earlier").alias("a"), F.col("id").alias("b")).filter("a IS NOT NULL").distinct()

    def apart(buckets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Members of large buckets, those of them that are in several components, and the most outside the largest."""
        members = common.stored(_placed(buckets.filter(F.col("n") > FEW).select("key", "id"), found))
        mixed = common.stored(_mixed(members))
        return members, mixed, mixed.agg(F.max("apart")).collect()[0][0] or 0

    buckets = common.stored(_buckets(keyed))
    pairs = common.stored(compared(buckets))
    candidates = common.stored(records.join(ends(pairs).hint("shuffle_hash"), "id", "left_semi"))
    tested = common.stored(_tested(pairs, candidates, near))
    common.dropped(pairs)
    # all that any comparison may ask for, so that texts are read once
    asked = common.stored(ends(tested).unionByName(buckets.filter(F.col("n") > FEW).select("id")).distinct())
    links = common.stored(verified(tested, asked))
    found = common.stored(components(links))
    members, sizes, most = apart(buckets)
    mixed = sizes
    common.dropped(buckets, tested, links)
    if most > APART:
        ids = common.stored(members.join(sizes, "key").select("id").distinct())
        common.dropped(members, sizes)
        common.dropped(candidates)
        candidates, near = common.stored(finer(ids)), closer
        common.dropped(ids)
        buckets = common.stored(_buckets(candidates.select(F.explode("keys").alias("key"), "id")))
        pairs = compared(buckets)
        at = [found.withColumnsRenamed({"id": c, "component": f"component_{c}"}) for c in "ab"]
        pairs = pairs.join(at[0], "a", "left").join(at[1], "b", "left").filter("coalesce(component_a, a) != coalesce(component_b, b)").select("a", "b")
        tested = common.stored(_tested(pairs, candidates, near))
        links = common.stored(verified(tested, asked))
        found = _joined(found, links)
        members, sizes, most = apart(buckets)
        common.dropped(buckets, tested, links)
        # of buckets with the same members the one of the least key stands for all
        sets = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("all"), F.sum(F.col("id") % (1 << 31)).alias("sum"))
        mixed = sizes.join(sets, "key").groupBy("n", "all", "sum").agg(F.min(F.struct("key", "main")).alias("one")).select("one.*")
    if most:
        once = F.col("keys") if "keys" in candidates.columns else None
        across = common.stored(_across(members.join(mixed, "key"), candidates, near, once))
        links = common.stored(verified(across, asked))
        found = _joined(found, links)
        common.dropped(across, links)
    common.dropped(members, sizes, candidates, asked)
    return found
