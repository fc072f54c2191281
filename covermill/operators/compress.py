"""Raw tokens to effective types: clusters inside groups of equal chemistry, and frozen maps for later data."""

from __future__ import annotations

import difflib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions.scalar import piece_tokens
from covermill.operators.components import components
from covermill.operators.setsim import overlap_links, token_sets
from covermill.session import Scratch, small_side


def ward_labels(x: np.ndarray, most: float) -> np.ndarray:
    """Ward clusters: merges with a height of at most ``most``, by chains of nearest neighbours; labels from 1 in
    the order of first appearance. Heights are ``sqrt(2 a b / (a + b)) * distance of the centers``."""
    n = len(x)
    label = np.arange(n)
    centers, sizes, alive = x.astype(np.float64).copy(), np.ones(n), np.ones(n, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    left = n
    while left > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        heights = np.sqrt(2 * sizes[i] * sizes / (sizes[i] + sizes)) * np.sqrt(((centers - centers[i]) ** 2).sum(axis=1))
        heights[~alive] = np.inf
        heights[i] = np.inf
        j = int(heights.argmin())
        if len(chain) > 1 and heights[chain[-2]] <= heights[j]:
            j = chain[-2]
            merges.append((float(heights[j]), i, j))
            chain = chain[:-2]
            total = sizes[i] + sizes[j]
            centers[j] = (sizes[i] * centers[i] + sizes[j] * centers[j]) / total
            sizes[j], alive[i] = total, False
            left -= 1
        else:
            chain.append(j)
    for height, i, j in merges:
        # a merge below the limit has only merges below the limit under it
        if height <= most:
            label[label == label[i]] = label[j]
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    order = np.empty(len(first), dtype=np.int64)
    order[np.argsort(first, kind="stable")] = np.arange(1, len(first) + 1)
    return order[back.reshape(-1)]


def topology_ratio(a: str, b: str) -> float:
    """Similarity of two token names: 0.6 of the sequence ratio and 0.4 of the overlap of their pieces."""
    import re

    pieces = [set(re.findall(r"[A-Za-z]+|\d+\.\d+|\d+|[^\sA-Za-z0-9]", s)) for s in (a, b)]
    either = pieces[0] | pieces[1]
    overlap = len(pieces[0] & pieces[1]) / len(either) if either else 1.0
    return 0.6 * difflib.SequenceMatcher(None, a, b).ratio() + 0.4 * overlap


def _ward(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("raw", ignore_index=True)
    x = np.stack([np.asarray(v) for v in pdf["x"]])
    labels = ward_labels(x, 1.0)
    firsts = pdf["raw"].groupby(labels).transform("first")
    return pd.DataFrame({"raw": pdf["raw"], "meta": pdf["meta"], "first": firsts})


def fit_types(scratch: Scratch, dim: DataFrame, bond: float = 0.05, angle: float = 5.0, share: float = 0.5, topology: float = 1.0) -> DataFrame:
    """``raw, meta, type`` for ``dim(raw, meta, feature)``: Ward clusters of the features in each group of one meta.

    A raw token without meta is a group of its own. Groups where less than ``share`` have a feature, or features
    differ in length, are not clustered by them, nor are tokens without a feature; below a ``topology`` of 1 these are
    clustered by the similarity of their names. Clusters are merged up to a height of one tolerance in every coordinate. Points farther apart than that height are never merged, directly or later: a cluster
    of ``a`` points made by lower merges has a mean square spread below half of the height's square times ``1 - 1/a``,
    so two clusters without any near pair are merged at a larger height. So each group is first taken apart into the
    components of near points, by joins, and a task clusters one component and not a whole group.
    """
    rows = dim.groupBy("raw").agg(F.min("meta").alias("meta"), F.min("feature").alias("feature"))
    feature = F.col("feature").cast("array<float>").cast("array<double>")
    rows = scratch.keep(rows.select("raw", F.coalesce("meta", "raw").alias("meta"), F.when(F.size("feature") > 2, feature).alias("feature")))
    groups = rows.groupBy("meta").agg(F.count("*").alias("n"), F.count("feature").alias("with"), F.min(F.when(F.col("feature").isNotNull(), F.size("feature"))).alias("lo"), F.max(F.when(F.col("feature").isNotNull(), F.size("feature"))).alias("hi"))
    groups = groups.where((F.col("lo") == F.col("hi")) & (F.col("with") >= share * F.col("n")) & (F.col("n") > 1)).select("meta", F.lit(True).alias("even"))
    known = scratch.keep(rows.join(groups, "meta", "left"))
    scale = f"if(i < size(feature) - 2, {max(bond, 1e-10)!r}D, {max(angle, 1e-10)!r}D) * sqrt(size(feature))"
    points = scratch.keep(known.where("even and feature is not null").select("raw", "meta", F.expr(f"transform(feature, (v, i) -> v / ({scale}))").alias("x")))
    near = distance_components(scratch, points.select(F.col("meta").alias("group"), F.col("raw").alias("id"), "x"), 1 + 1e-9)
    clustered = points.join(near.withColumnRenamed("id", "raw"), "raw").groupBy("meta", "cluster").applyInPandas(_ward, "raw string, meta string, first string")
    alone = known.where("even is null or feature is null").select("raw", "meta", F.col("raw").alias("first"))
    if topology < 1:
        names = scratch.keep(alone)
        links = topology_links(scratch, names.select(F.col("meta").alias("group"), F.col("raw").alias("name")), topology)
        alike = components(scratch, links.select("a", "b")).select(F.col("item").alias("raw"), "root")
        alone = names.join(alike, "raw", "left").select("raw", "meta", F.coalesce("root", "raw").alias("first"))
    turn = F.dense_rank().over(Window.partitionBy("meta").orderBy("first"))
    return clustered.unionByName(alone).select("raw", "meta", F.format_string("%s:sim%05d", "meta", turn).alias("type"))


def frozen_types(raws: DataFrame, frozen: DataFrame) -> DataFrame:
    """``raw, type, is_new`` for ``raws(raw, meta)`` by a stored map ``frozen(raw, type)``; a raw token that the map
    lacks gets ``<meta or raw>:frozen_new:<8 digits of its sha1>``."""
    rows = raws.groupBy("raw").agg(F.min("meta").alias("meta")).join(frozen.select("raw", "type").dropDuplicates(["raw"]), "raw", "left")
    new = F.concat(F.coalesce("meta", "raw"), F.lit(":frozen_new:"), F.substring(F.sha1("raw"), 1, 8))
    return rows.select("raw", F.coalesce("type", new).alias("type"), F.col("type").isNull().alias("is_new"))


def compression_stats(dim: DataFrame) -> DataFrame:
    """One row: raw tokens, types, groups, singletons and ``reduction_pct`` of ``dim(raw, meta, type)``."""
    by_type = dim.groupBy("type").agg(F.countDistinct("raw").alias("n"), F.min("meta").alias("meta"))
    out = by_type.agg(F.sum("n").alias("n_raw"), F.count("*").alias("n_effective"), F.countDistinct("meta").alias("n_meta"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.max("n").alias("largest"))
    out = out.na.fill(0, ["n_raw", "largest"])
    return out.withColumn("reduction_pct", 100.0 * (1 - F.col("n_effective") / F.greatest(F.lit(1), "n_raw")))


#: Points of a block; two blocks meet in one task.
BLOCK = 2000
#: Points of a group whose distances to all others make the cells.
PIVOTS = 3


def _near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distances of the pairs that are at most ``threshold`` apart, by a matrix product; what that leaves
    in doubt is taken again as a sum of squares."""
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    i, j = np.nonzero(squares - 2 * x @ y.T <= threshold * threshold + 1e-9 * (1 + squares))
    exact = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
    keep = exact <= threshold
    return i[keep], j[keep], exact[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links ``a[k], b[k]`` join what the links before them do not."""
    root: dict = {}

    def find(v):
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    keep = np.zeros(len(a), dtype=bool)
    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = find(p), find(q)
        if p != q:
            root[q] = p
            keep[k] = True
    return keep


def _block_links(threshold: float, forest: bool):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pdf["id"][:0], "b": pdf["id"][:0], "distance": np.empty(0)})
        i, j, apart = _near_pairs(np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy()), threshold)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        # a block that meets itself has each pair twice
        once = (a < b) if bool(pdf["same"].iloc[0]) else np.ones(len(a), dtype=bool)
        a, b, apart = a[once], b[once], apart[once]
        if forest:
            kept = _forest(a, b)
            a, b, apart = a[kept], b[kept], apart[kept]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "distance": apart})

    return links


def distance_links(scratch: Scratch, points: DataFrame, threshold: float, forest: bool = False, block: int = BLOCK) -> DataFrame:
    """``a, b, distance`` with ``a < b`` in one group and at most ``threshold`` apart, for ``points(group, id, x)``; with
    ``forest``, only links that connect the same points, so a dense group has no more links than points in each task.

    Points lie in cells by their distances to a few pivots of their group, which differ by at most ``threshold`` for a
    pair within it; a cell meets those around it that there are, and itself. Cells are dealt into blocks, and two blocks
    meet in a task, so neither a large cell nor a large group is one task's work; where the threshold is as wide as
    the distances spread (as for unit vectors of many dimensions) the blocks of a group all meet. A null group, and
    points without coordinates or with another number of them than the pivots, link nothing.
    """
    rows = points.select("group", "id", F.col("x").cast("array<double>").alias("x")).where("`group` is not null and id is not null and size(x) > 0")
    rows = scratch.keep(rows.withColumn("dims", F.size("x")))
    pivots = rows.groupBy("group", "dims").agg(F.array(*[F.min_by("x", F.xxhash64("id", F.lit(k))) for k in range(PIVOTS)]).alias("p"))
    apart = "cast(floor(sqrt(aggregate(zip_with(x, p[{0}], (u, v) -> (u - v) * (u - v)), 0D, (s, v) -> s + v)) / {1!r}D) as long)"
    cells = [f"c{k}" for k in range(PIVOTS)]
    # a little wider than the threshold, so that rounding puts no pair two cells apart
    placed = rows.join(small_side(scratch.keep(pivots), 1_000), ["group", "dims"]).select("group", "dims", "id", "x", *[F.expr(apart.format(k, threshold * (1 + 1e-9) + 1e-12)).alias(c) for k, c in enumerate(cells)])
    placed = scratch.keep(placed)
    key = ["group", "dims", *cells]
    sizes = scratch.keep(placed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    # of two cells around each other, the one that is not less in the order of their numbers sends; a cell meets itself
    steps = [t for t in itertools.product((-1, 0, 1), repeat=PIVOTS) if t >= (0,) * PIVOTS]
    moved = sizes.select(*key, "blocks", F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{k}") for k, v in enumerate(t)]) for t in steps])).alias("t"))
    moved = moved.select(*[F.col(c).alias(f"l_{c}") for c in key], F.col("blocks").alias("l_blocks"), "group", "dims", *[(F.col(c) + F.col(f"t.s{k}")).alias(c) for k, c in enumerate(cells)])
    meets = moved.join(sizes, key).withColumn("own", F.expr(" and ".join(f"l_{c} = {c}" for c in cells)))
    meets = meets.withColumn("bi", F.explode(F.expr("sequence(0, l_blocks - 1)"))).withColumn("bj", F.explode(F.expr("sequence(if(own, bi, 0), blocks - 1)")))
    meets = scratch.keep(meets.select("*", F.xxhash64(*[f"l_{c}" for c in key], *cells, "bi", "bj").alias("task"), F.expr("own and bi = bj").alias("same")))
    dealt = placed.join(small_side(sizes), key).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).select(*key, "block", "id", "x")
    left = meets.select(*[F.col(f"l_{c}").alias(c) for c in key], F.col("bi").alias("block"), "task", "same", F.lit(0).alias("side"))
    right = meets.select(*key, F.col("bj").alias("block"), "task", "same", F.lit(1).alias("side"))
    met = dealt.join(left.unionByName(right), [*key, "block"]).select("task", "same", "side", "id", "x")
    kind = rows.schema["id"].dataType.simpleString()
    return met.groupBy("task").applyInPandas(_block_links(threshold, forest), f"a {kind}, b {kind}, distance double")


def distance_components(scratch: Scratch, points: DataFrame, threshold: float) -> DataFrame:
    """``id, cluster``: single linkage inside each group; ``cluster`` is the smallest id of it.

    Equal points of a group are one before any pair is looked at. Null coordinates and ids are in no pair.
    """
    rows = points.select("group", "id", F.col("x").cast("array<double>").alias("x"))
    firsts = scratch.keep(rows.groupBy("group", "x").agg(F.min("id").alias("first")))
    roots = components(scratch, distance_links(scratch, firsts.withColumnRenamed("first", "id"), threshold, forest=True).select("a", "b"))
    firsts = firsts.join(roots.withColumnRenamed("item", "first"), "first", "left").select("group", "x", F.coalesce("root", "first").alias("cluster"))
    same = F.expr("p.`group` <=> f.`group` and p.x <=> f.x")
    named = rows.alias("p").join(firsts.alias("f"), same)
    return named.select("p.id", F.when(F.col("p.x").isNull(), F.col("p.id")).otherwise(F.col("f.cluster")).alias("cluster"))


def topology_links(scratch: Scratch, names: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of ``names(group, name)`` with a similarity of at least ``threshold`` and ``a < b``; at 1
    or more none.

    The sequence ratio is at most 1, so the overlap of the pieces is at least ``(threshold - 0.6) / 0.4``, which must
    be above 0: names meet by their rarest pieces within the group, enough for that overlap. Then lengths, which bound
    the ratio, thin the pairs before it is taken. A null group is a group; null names have no links.
    """
    if threshold >= 1:
        return names.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity")).limit(0)
    if threshold <= 0.6:
        raise ValueError("a threshold of 0.6 or less would have to compare every pair")
    rows = names.select(F.coalesce(F.concat(F.lit("g"), F.col("group").cast("string")), F.lit("n")).alias("g"), "name").where("name is not null").distinct()
    spread = rows.select(F.struct("g", "name").alias("item"), F.explode(piece_tokens(F.col("name"))).alias("piece"))
    sets = token_sets(scratch, spread.select("item", F.concat_ws("\x1f", "item.g", "piece").alias("env")))
    pairs = overlap_links(sets, (threshold - 0.6) / 0.4, None)
    pairs = pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), "overlap")
    shorter, both = F.least(F.length("a"), F.length("b")), F.length("a") + F.length("b")
    pairs = pairs.where(0.6 * 2 * shorter / both + 0.4 * F.col("overlap") >= threshold - 1e-9)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b)], dtype=float)

    found = pairs.select("a", "b", (0.6 * ratio("a", "b") + 0.4 * F.col("overlap")).alias("similarity"))
    return found.where(F.col("similarity") >= threshold - 1e-12)
