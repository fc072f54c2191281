"""Problem 6: groups of records that are the same but for small edits, by chosen paths.

In each run a record chooses every token of its set with probability ``1 / (threshold * n)``, by a hash that all
records share, so two similar records choose a common token with a chance that depends on their overlap only. A
chosen token is a bucket; a bucket of many records is split by further chosen tokens, its path, until it is small or
all its records are known to be linked, and small buckets are compared pairwise. Runs are repeated until a pair at
the threshold is missed with a chance of at most ``miss``; the groups close over what single pairs miss.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.groups import connected
from covermill.llm.records import Classes, Threshold, verified
from covermill.session import Scratch, is_empty, small_side

#: Records of a bucket that are compared pairwise; a larger one is split.
SMALL_BUCKET = 256
#: Tokens of a path from which on the records of a large bucket are compared with a pivot before it is split.
PIVOT_FROM = 6
#: Pivots with their sets that may be broadcast.
MOST_PIVOTS = 1_000
#: Tokens of a path after which a bucket is compared pairwise, whatever its size.
LONGEST_PATH = 12


def runs_needed(t: Threshold, miss: float) -> int:
    """Runs after which a pair at the threshold has shared no first token with a chance of at most ``miss``."""
    # of n tokens each, 2 * num / (num + den) * n are shared, and each is chosen with den / (num * n)
    return math.ceil(math.log(1 / miss) * (t.num + t.den) / (2 * t.den))


def _chosen(path: str, t: Threshold) -> str:
    return f"shiftrightunsigned(xxhash64({path}, token), 11) / 9007199254740992D < {t.den}D / ({t.num}D * n)"


class _Buckets:
    def __init__(self, scratch: Scratch, sets: DataFrame, t: Threshold, small: int):
        self.scratch, self.sets, self.t, self.small = scratch, sets, t, small
        tokens = sets.select(F.explode("tokens").alias("token"))
        frequent = scratch.keep(tokens.groupBy("token").agg(F.count("*").alias("load")).where(F.col("load") > small).select("token"))
        #: The tokens of more than ``small`` records; every bucket whose path has another token is small.
        self.frequent = small_side(frequent).withColumn("is_frequent", F.lit(True))

    def first(self, runs: int) -> DataFrame:
        """``key, id, n, parity`` for each run and chosen token that is not frequent."""
        rows = self.sets.select("id", "n", "parity", F.explode("tokens").alias("token")).join(self.frequent, "token", "left").where("is_frequent is null")
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).where(_chosen("run", self.t))
        return rows.select(F.xxhash64("run", "token").alias("key"), "id", "n", "parity")

    def second(self, runs: int) -> DataFrame:
        """``key, id, n, parity, root, is_frequent`` for each run, chosen frequent token and further chosen token; all
        of it where the set is, without a shuffle."""
        rows = self.sets.select("id", "n", "parity", "tokens", F.explode("tokens").alias("token")).join(self.frequent.select("token"), "token")
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).where(_chosen("run", self.t))
        return self._longer(rows.withColumn("key", F.xxhash64("run", "token")).withColumn("root", F.col("id")).drop("token"))

    def further(self, large: DataFrame) -> DataFrame:
        """The rows of ``large`` with their paths one token longer, for each token that they choose."""
        rows = large.select("key", "id", "root").join(self.sets.select("id", "n", "parity", "tokens"), "id")
        return self._longer(rows)

    def _longer(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "id", "n", "parity", "root", F.explode("tokens").alias("token")).where(_chosen("key", self.t))
        rows = rows.join(self.frequent, "token", "left")
        return rows.select(F.xxhash64("key", "token").alias("key"), "id", "n", "parity", "root", "is_frequent")

    def sized(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of small buckets, and rows of large ones without those whose records are all linked (``None`` where
        there are none). Sizes are counted with partial sums, and only the keys of large buckets meet the rows again."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("size") > self.small)
        sizes = self.scratch.keep(sizes)
        few, keys = rows.join(small_side(sizes.select("key")), "key", "left_anti"), sizes.where("lo < hi").select("key")
        return few, None if is_empty(keys) else rows.join(small_side(keys), "key")

    def linked(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of each large bucket's records with one of them, its pivot, and the rows with the pivot as ``root``
        where they are linked to it, of buckets that have others."""
        pivots = large.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("pivot"))
        named = lambda x: self.sets.select(F.col("id").alias(x), F.col("tokens").alias(f"tokens_{x}"))
        pivots = small_side(self.scratch.keep(pivots.join(named("pivot"), "pivot")), MOST_PIVOTS)
        shared = "size(array_intersect(tokens_pivot, tokens_id))"
        near = F.expr(self.t.reached(shared, "size(tokens_pivot)", "size(tokens_id)")).alias("near")
        rows = large.join(pivots, "key").join(named("id"), "id").select("key", "id", "n", "parity", "root", "pivot", near)
        rows = self.scratch.keep(rows.withColumn("root", F.when(F.col("near"), F.col("pivot")).otherwise(F.col("root"))))
        mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        links = rows.where("near and id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        return links, rows.join(small_side(mixed), "key").select("key", "id", "n", "parity", "root")


def bucket_rows(scratch: Scratch, sets: DataFrame, t: Threshold, runs: int, small: int = SMALL_BUCKET, longest: int = LONGEST_PATH) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """``key, id, n, parity`` of the small buckets, the same of what is still large after the longest paths (or
    ``None``), and links ``a, b`` met on the way."""
    buckets = _Buckets(scratch, sets, t, small)
    cols = ["key", "id", "n", "parity"]
    rows, done, links = buckets.second(runs), buckets.first(runs), []
    for depth in range(2, longest + 1):
        done = done.unionByName(rows.where("is_frequent is null").select(cols))
        frequent = rows.where("is_frequent").drop("is_frequent")
        few, large = buckets.sized(scratch.keep(frequent) if depth == 2 else frequent)
        done = done.unionByName(few.select(cols))
        if large is None:
            return done, None, links
        if depth >= PIVOT_FROM:
            more, large = buckets.linked(large)
            links.append(more)
        if depth < longest:
            rows = scratch.keep(buckets.further(large))
    return done, large.select(cols), links


def similar_links(scratch: Scratch, sets: DataFrame, t: Threshold, miss: float, small: int = SMALL_BUCKET) -> DataFrame:
    """Links ``a, b`` of classes that reach the threshold; every group that the pairs met in a bucket make is whole.

    First each record of a small bucket is compared with the bucket's smallest, which links most members of a family
    to one record; of the other pairs, those of records linked to the same one need no look.
    """
    done, large, links = bucket_rows(scratch, sets, t, runs_needed(t, miss), small)
    members = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "n", "parity"))).alias("m")).where("size(m) > 1").select("m")
    first = members.select("m", F.posexplode("m").alias("i", "x")).where("i + 1 < size(m)")
    met = first.select("i", "x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y")).where(t.may_pass("x", "y"))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("i = 0").alias("star"))
    if large is not None:
        met = large.alias("x").join(large.alias("y"), F.expr(f"x.key = y.key and x.id < y.id and {t.may_pass('x', 'y')}"))
        pairs = pairs.unionByName(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(False).alias("star")))
    pairs = scratch.keep(pairs.groupBy("a", "b").agg(F.max("star").alias("star")))
    near = scratch.keep(verified(pairs.where("star"), sets, t).select("a", "b"))
    tops = near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("top"))
    pairs = pairs.where("not star")
    for end in ("a", "b"):
        pairs = pairs.join(tops.select(F.col("id").alias(end), F.col("top").alias(f"top_{end}")), end, "left")
    pairs = pairs.where("coalesce(top_a, a) <> coalesce(top_b, b)").select("a", "b")
    found = verified(pairs, sets, t).select("a", "b").unionByName(near)
    for more in links:
        found = found.unionByName(more)
    return found


def similar_groups(scratch: Scratch, found: Classes, t: Threshold, miss: float = 1e-6, small: int = SMALL_BUCKET) -> DataFrame:
    """``id, group_id`` of every record with a similar one, directly or through others; copies count as similar.

    ``group_id`` is the smallest id. Records alone, and records without values, have no row.
    """
    links = scratch.keep(similar_links(scratch, found.sets, t, miss, small))
    groups = connected(scratch, links).select(F.col("id").alias("rep"), "group_id")
    alone = found.members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1").select("rep")
    named = found.members.join(groups, "rep", "left").join(alone.withColumn("copied", F.lit(True)), "rep", "left")
    return named.where("group_id is not null or copied").select("id", F.coalesce("group_id", "rep").alias("group_id"))
