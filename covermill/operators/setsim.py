"""Set similarity on the incidence relation: exact copies, overlap with a size band, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.operators.components import components
from covermill.session import Scratch


#: A token in more than one of so many rows is a hot key; there are fewer than this number of them.
HOT_SHARE = 4096


def token_sets(scratch: Scratch, inc: DataFrame) -> DataFrame:
    """``item, n, parity, tokens``: the envs of each item as 64-bit hashes, the rarest first in one order for all items.

    The fewer than ``HOT_SHARE`` hot tokens get their counts by a broadcast, the others by a shuffle. ``parity`` has bit
    ``token % 64`` flipped once per token, so the bits in which two items differ are at most the tokens in which they do.
    """
    rows = inc.select("item", F.xxhash64("env").alias("token"))
    counts = scratch.keep(rows.groupBy("token").agg(F.count("*").alias("load")))
    most = (counts.agg(F.sum("load")).first()[0] or 0) // HOT_SHARE
    marked = rows.join(F.broadcast(counts.where(F.col("load") > most)), "token", "left")
    loaded = marked.where("load is not null").select("item", "token", "load")
    loaded = loaded.unionByName(marked.where("load is null").select("item", "token").join(counts.where(F.col("load") <= most), "token"))
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    sets = loaded.groupBy("item").agg(F.count("*").cast("int").alias("n"), F.bit_xor(bit).alias("parity"), F.array_sort(F.collect_list(F.struct("load", "token"))).alias("s"))
    return scratch.keep(sets.select("item", "n", "parity", F.col("s.token").alias("tokens")))


def exact_copies(inc: DataFrame) -> DataFrame:
    """``item, first``: the smallest item with the same set; partial aggregation meets copies before the shuffle."""
    sets = inc.groupBy("item").agg(F.array_sort(F.collect_set("env")).alias("envs")).select("item", F.sha2(F.concat_ws("\x1f", "envs"), 256).alias("sig"))
    firsts = sets.groupBy("sig").agg(F.min("item").alias("first"))
    return sets.join(firsts, "sig").select("item", "first")


def overlap_links(sets: DataFrame, threshold: float, band: float | None) -> DataFrame:
    """``a, b, overlap`` with ``a < b``, overlap at least ``threshold`` and, with a band, the larger set at most
    ``int(smaller * (1 + band)) + 1``. The band is part of the result: at low thresholds it drops pairs.

    Only prefixes are joined: two sets at the threshold share one of their rarest ``n - ceil(threshold * n) + 1``
    tokens. Sizes, the positions of the shared token and parity thin the pairs before the sets are compared. Copies
    should be collapsed before (see ``class_links``).
    """
    prefix = F.expr(f"slice(tokens, 1, n - cast(ceil({threshold}D * n - 1e-9) as int) + 1)")
    rows = sets.select("item", "n", "parity", F.posexplode(prefix).alias("pos", "token"))
    sized = f"least(x.n, y.n) >= {threshold}D * greatest(x.n, y.n) - 1e-9"
    if band is not None:
        sized += f" and greatest(x.n, y.n) <= cast(floor(least(x.n, y.n) * {1 + band}D) as int) + 1"
    common = f"ceil({threshold}D * (x.n + y.n) / {1 + threshold}D - 1e-9)"
    room = f"least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos) >= {common} and bit_count(x.parity ^ y.parity) <= x.n + y.n - 2 * {common}"
    met = rows.alias("x").join(rows.alias("y"), F.expr(f"x.token = y.token and x.item < y.item and {sized} and {room}"))
    pairs = met.select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).distinct()
    left = sets.select(F.col("item").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("item").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("k", F.size(F.array_intersect("ta", "tb")))
    both = both.withColumn("overlap", F.col("k") / (F.size("ta") + F.size("tb") - F.col("k")))
    return both.where(F.col("overlap") >= threshold - 1e-12).select("a", "b", "overlap")


def class_links(scratch: Scratch, inc: DataFrame, threshold: float, band: float | None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, ``item, first``, and the links ``a, b, overlap`` of their first items. Together they
    hold every link of ``inc``; a group of copies of any size costs one row in the joins and none in the links."""
    copies = scratch.keep(exact_copies(inc))
    sets = token_sets(scratch, inc.join(copies.where("item = first").select("item"), "item", "left_semi"))
    return copies, overlap_links(sets, threshold, band)


def links_of_items(copies: DataFrame, links: DataFrame) -> DataFrame:
    """``item, class_id, n_copies, n_links``: one row per item with its class, the other items of it, and the items
    of other classes that it is linked with."""
    sizes = copies.groupBy("first").agg(F.count("*").alias("size"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(sizes.select(F.col("first").alias("b"), "size"), "b").groupBy(F.col("a").alias("first")).agg(F.sum("size").alias("n_links"))
    rows = copies.join(sizes, "first").join(near, "first", "left").na.fill(0, ["n_links"])
    return rows.select("item", F.col("first").alias("class_id"), (F.col("size") - 1).alias("n_copies"), "n_links")


def representatives(scratch: Scratch, inc: DataFrame, threshold: float, band: float | None, largest: bool = True) -> DataFrame:
    """``item, root, is_kept``: components of similar items; of each the one with the largest set stays, of equals
    the smallest (``largest=False``: the smallest item). A threshold of 1 or more compares exact sets only."""
    if threshold >= 1:
        return exact_copies(inc).select("item", F.col("first").alias("root"), (F.col("item") == F.col("first")).alias("is_kept"))
    copies = scratch.keep(exact_copies(inc))
    sets = token_sets(scratch, inc.join(copies.where("item = first").select("item"), "item", "left_semi"))
    roots = components(scratch, overlap_links(sets, threshold, band).select("a", "b"))
    named = sets.select("item", "n").join(roots, "item", "left").select("item", "n", F.coalesce("root", "item").alias("root"))
    best = F.min(F.struct(F.col("n") * (-1 if largest else 0), F.col("item"))).alias("best")
    kept = named.join(named.groupBy("root").agg(best), "root").select("item", "root", F.col("best.item").alias("kept"))
    rows = copies.join(kept.withColumnRenamed("item", "first"), "first")
    return rows.select("item", "root", (F.col("item") == F.col("kept")).alias("is_kept"))


def deduplicated(scratch: Scratch, inc: DataFrame, threshold: float, band: float | None = 0.25) -> DataFrame:
    """Incidence of the items that stay."""
    kept = representatives(scratch, inc, threshold, band).where("is_kept").select("item")
    return inc.join(kept, "item", "left_semi").select("item", "env")
