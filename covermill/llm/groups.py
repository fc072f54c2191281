"""Problem 3: consolidating pairwise matches into groups.

Rounds on tables only shrink the graph of links: vertices with one link are stripped and chains of vertices with two
links are compressed, both by one list ranking (pointer jumping over directed links, which finds both ends of every
chain in a number of steps logarithmic in its length; a leaf is a chain that ends at once). What is left, where every
vertex had three links or more, is the core: one of a bounded number of links is solved by one task; a larger one goes
on by rounds and is contracted around each vertex's smallest neighbour if a round removed less than half. Every removed vertex remembers the vertex that it hung on, and labels go back along these at the end. Stars
vanish in one round, long chains and trails in a logarithmic number of steps.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.operators.components import to_roots
from covermill.session import Scratch

#: Links of a core that one task solves; the groups are the same at any value.
CORE = 100_000
#: Hops along the chain in a step, so that pointers grow fourfold.
HOPS = 3
#: A vertex with more than one of so many link ends is a hub; there are fewer than this number of them.
HUB_SHARE = 4096


def _vertices(links: DataFrame) -> DataFrame:
    """``v, degree, lo, hi``: the number of links and the smallest and largest neighbour."""
    arcs = links.select(F.explode(F.expr("array(struct(x as v, y as w), struct(y as v, x as w))")).alias("arc")).select("arc.*")
    return arcs.groupBy("v").agg(F.count("*").alias("degree"), F.min("w").alias("lo"), F.max("w").alias("hi"))


def _rank(scratch: Scratch, vertices: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """List ranking of the chains of vertices with one or two links.

    ``arcs``: the links out of such vertices, directed: ``u, w, x, y``. ``ends``: for each arc the vertex outside of
    chains at which it ends, the number of steps to it, or for a chain that ends in a leaf or is a closed ring null,
    and the smallest vertex on the way: ``u, w, end, steps, low``. And the tables that are not needed later.
    """
    inner = vertices.where("degree <= 2")
    arcs = inner.select("v", "degree", F.explode(F.expr("array_distinct(array(struct(lo as w, hi as other), struct(hi as w, lo as other)))")).alias("a"))
    arcs = scratch.keep(arcs.select(F.col("v").alias("u"), "degree", "a.w", "a.other", F.expr("least(v, a.w)").alias("x"), F.expr("greatest(v, a.w)").alias("y")))
    # the arc goes on where its link is an arc of its other end too and that has another link
    at = lambda c: F.max(F.expr(f"if(u = {c}, struct(degree, other), null)")).alias(f"at_{c}")
    state = arcs.join(arcs.groupBy("x", "y").agg(at("x"), at("y")), ["x", "y"]).withColumn("ahead", F.expr("if(w = x, at_x, at_y)"))
    on = "ahead is not null and ahead.degree = 2"
    state = scratch.keep(
        state.select("u", "w", F.expr(f"if({on}, w, null)").alias("to_u"), F.expr(f"if({on}, ahead.other, null)").alias("to_w"), F.expr(f"not ({on})").alias("done"), F.expr("if(ahead is null, w, null)").alias("end"), F.lit(1).cast("long").alias("steps"), F.least("u", "w").alias("low"))
    )
    ended = [state.where("done")]
    open_arcs = state.where("not done")
    before, used = None, [arcs, state]
    while True:
        # both a fixed number of open arcs and fixed lowest vertices: only rings are left, and they know their lowest
        now = open_arcs.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before = now
        every = reduce(DataFrame.unionByName, ended).unionByName(open_arcs)
        target = every.select(F.col("u").alias("to_u"), F.col("w").alias("to_w"), F.col("to_u").alias("next_u"), F.col("to_w").alias("next_w"), F.col("done").alias("next_done"), F.col("end").alias("next_end"), F.col("steps").alias("more"), F.col("low").alias("next_low"))
        jumped = open_arcs
        for _ in range(HOPS):
            # an arc that is done points at none
            met = jumped.join(target, ["to_u", "to_w"], "left")
            jumped = met.select("u", "w", F.col("next_u").alias("to_u"), F.col("next_w").alias("to_w"), F.coalesce("next_done", "done").alias("done"), F.coalesce("end", "next_end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", "next_low").alias("low"))
        jumped = scratch.keep(jumped)
        used.append(jumped)
        ended.append(jumped.where("done"))
        open_arcs = jumped.where("not done")
    cols = ["u", "w", "end", "steps", "low"]
    return arcs, reduce(DataFrame.unionByName, [d.select(cols) for d in [*ended, open_arcs]]), used


def _without_chains(scratch: Scratch, links: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``v, p`` of all vertices with one or two links, and the links that are left. A chain between two other vertices
    becomes a link of these, its vertices hang on the nearer one; a chain with one such end hangs on it; one without
    (a trail or ring by itself) on its smallest vertex."""
    arcs, ends, used = _rank(scratch, vertices)
    near = F.min(F.when(F.col("end").isNotNull(), F.struct("steps", "end"))).alias("near")
    both = ends.groupBy("u").agg(F.min("end").alias("x"), F.max("end").alias("y"), F.count("end").alias("ends"), near, F.min("low").alias("low"))
    both = scratch.keep(both.select("u", "x", "y", "ends", F.expr("if(ends = 0, low, near.end)").alias("p")))
    # a join on the whole link, not on a vertex: a vertex with many links fills no task
    rest = links.join(arcs.select("x", "y").distinct(), ["x", "y"], "left_anti").select("x", "y")
    bridges = both.where("ends = 2 and x < y").select("x", "y")
    rest = scratch.keep(rest.unionByName(bridges).distinct())
    scratch.drop(*used)
    return both.where("u <> p").select(F.col("u").alias("v"), "p"), rest


def _moved(links: DataFrame, end: str, roots: DataFrame, hubs: DataFrame) -> DataFrame:
    """Links with one end replaced by its root; those of hubs, which are few, by a broadcast."""
    named = lambda df: df.select(F.col("v").alias(end), F.col("p").alias("to"))
    rows = links.join(F.broadcast(named(hubs)), end, "left")
    known = rows.where("to is not null")
    others = rows.where("to is null").drop("to").join(named(roots), end, "left")
    return known.unionByName(others).withColumn(end, F.coalesce("to", end)).drop("to")


def _contract(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vertex joins its smallest neighbour if that is smaller; the trees so made become one vertex each."""
    vertices = scratch.keep(_vertices(links))
    most = (vertices.agg(F.sum("degree")).first()[0] or 0) // HUB_SHARE
    roots = to_roots(scratch, vertices.where("lo < v").select("v", F.col("lo").alias("p")))
    hubs = vertices.where(F.col("degree") > most).select("v").join(roots, "v", "left").select("v", F.coalesce("p", "v").alias("p"))
    moved = _moved(_moved(links, "x", roots, hubs), "y", roots, hubs)
    rest = scratch.keep(moved.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    scratch.drop(vertices)
    return roots, rest


def _solved(pdf: pd.DataFrame) -> pd.DataFrame:
    """``v, p`` of a core's vertices, ``p`` the smallest of the group, without those that are it."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while (p := up.setdefault(v, v)) != v:
            up[v] = up[p]
            v = p
        return v

    for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist()):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    rows = [(v, p) for v in list(up) if (p := top(v)) != v]
    return pd.DataFrame(rows, columns=["v", "p"])


def connected(scratch: Scratch, links: DataFrame, core: int = CORE) -> DataFrame:
    """``id, group_id`` of every id in ``links(a, b)``; ``group_id`` is the smallest id linked directly or not.

    Repeated links, links of an id with itself and links given both ways are one; nulls link nothing. No link or
    label ever goes to the driver.
    """
    clean = links.where("a is not null and b is not null")
    ids = clean.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rest = scratch.keep(clean.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    hung: list[DataFrame] = []
    while left := rest.count():
        vertices = scratch.keep(_vertices(rest))
        gone, fewer = _without_chains(scratch, rest, vertices)
        scratch.drop(vertices, rest)
        hung.append(gone)
        rest = fewer
        now = rest.count()
        if 0 < now <= core:
            kind = rest.schema["x"].dataType.simpleString()
            hung.append(rest.groupBy(F.lit(0).alias("one")).applyInPandas(_solved, f"v {kind}, p {kind}"))
            break
        if now > left // 2:
            merged, rest = _contract(scratch, fewer)
            scratch.drop(fewer)
            hung.append(merged)
    if not hung:
        return ids.select("id", F.col("id").alias("group_id"))
    # each vertex was removed once, so what they hung on are trees; their roots give the labels back
    roots = to_roots(scratch, scratch.keep(reduce(DataFrame.unionByName, hung)))
    lowest = roots.groupBy("p").agg(F.min(F.least("v", "p")).alias("group_id"))
    named = roots.join(lowest, "p").select(F.col("v").alias("id"), "group_id").unionByName(lowest.select(F.col("p").alias("id"), "group_id"))
    return ids.join(named, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def match_groups(scratch: Scratch, pairs: DataFrame, left: str, right: str, score: str, least: float, core: int = CORE) -> DataFrame:
    """Groups of every id in either column; a row links its ids if both are there and its score is a number of at
    least ``least`` (null and NaN link nothing). Ids without links are their own group; an empty table gives none."""
    rows = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"), F.col(score).cast("double").alias("score"))
    ids = rows.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    linked = rows.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= least)).select("a", "b")
    return ids.join(connected(scratch, linked, core), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
