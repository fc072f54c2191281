"""Connected components by contraction: each vertex joins its smallest neighbour until no link is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.session import Scratch, is_empty


def to_roots(scratch: Scratch, up: DataFrame) -> DataFrame:
    """``v, p`` with ``p`` the root of ``v``'s tree, by pointer jumping; rounds are logarithmic in the depth."""
    last = None
    while True:
        above = up.select(F.col("v").alias("p"), F.col("p").alias("root"))
        jumped = scratch.keep(up.join(above, "p", "left").select("v", F.coalesce("root", "p").alias("p"), F.col("root").isNotNull().alias("moved")))
        if last is not None:
            scratch.drop(last)
        up, last = jumped.select("v", "p"), jumped
        if is_empty(jumped.where("moved")):
            return up


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``item, root`` of every item in ``links(a, b)``; ``root`` is the smallest item reached. Nulls link nothing."""
    clean = links.where("a is not null and b is not null")
    ids = clean.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    rest = scratch.keep(clean.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    trees = []
    while not is_empty(rest):
        # a vertex is always the larger end of some link or a root of this round
        up = scratch.keep(rest.groupBy(F.col("y").alias("v")).agg(F.min("x").alias("p")))
        roots = to_roots(scratch, up)
        trees.append(roots)
        before = rest
        moved = rest.join(roots.select(F.col("v").alias("x"), F.col("p").alias("to_x")), "x", "left").join(roots.select(F.col("v").alias("y"), F.col("p").alias("to_y")), "y", "left")
        moved = moved.select(F.coalesce("to_x", "x").alias("a"), F.coalesce("to_y", "y").alias("b")).where("a <> b")
        rest = scratch.keep(moved.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
        scratch.drop(up, before)
    if not trees:
        return ids.select("item", F.col("item").alias("root"))
    roots = to_roots(scratch, reduce(DataFrame.unionByName, trees))
    return ids.join(roots.select(F.col("v").alias("item"), F.col("p").alias("root")), "item", "left").select("item", F.coalesce("root", "item").alias("root"))
