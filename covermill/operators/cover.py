"""Covers: greedy selection, ranked manifests, redundancy sweeps, two tiers.

Greedy picks the item with the most uncovered envs, of equals the smallest. Gains only fall, and an item's gain falls
only when an item that shares an uncovered env is picked. So an item that goes before all items it shares an uncovered
env with is picked with its present gain whatever happens elsewhere: all such items are picked in one round, and the
picks sorted by gain and item are exactly the greedy sequence. A round also takes the next picks of the sequence from
the items with the largest gains: a bounded block of them goes through the sequential algorithm until its best item no
longer goes before the first item outside, whose gain can only have fallen. A sweep for redundant items runs in rounds
likewise. No round holds more than aggregates and one bounded block in a task, so a large component is no obstacle.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions.scalar import compared
from covermill.operators.incidence import classify, projected
from covermill.operators.setsim import deduplicated, exact_copies, overlap_links, token_sets
from covermill.session import Scratch, small_side

#: Incidences that one task takes: of a round's block, and of the rest that ends a cover or sweep. The picks are the
#: same at any value.
FINISH = 100_000
#: Most items of a round's block.
BLOCK = 4_000
#: Most items of a sweep's order that are broadcast, as keys and places may be texts.
MOST_ORDER = 100_000


def global_rank(scratch: Scratch, rows: DataFrame, order: list, total: str | None = None) -> DataFrame:
    """``rank`` by a total order and, of the column ``total``, its running sum ``covered``, over any number of rows.

    Rows are range-partitioned; a partition ranks its own rows and adds what the partitions before it hold, which is
    one row per partition.
    """
    summed = F.lit(0) if total is None else F.col(total)
    parts = scratch.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum(summed).alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    own = Window.partitionBy("part").orderBy(*order)
    ranked = parts.withColumn("r", F.row_number().over(own)).withColumn("c", F.sum(summed).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # a row for each of the shuffle's partitions, whose number is a setting
    ranked = ranked.join(F.broadcast(sizes), "part").withColumn("rank", F.col("r") + F.col("n"))
    if total is not None:
        ranked = ranked.withColumn("covered", F.col("c") + F.col("s"))
    return ranked.drop("part", "n", "s", "r", "c")


def _lazy_greedy(bound: tuple | None = None):
    """Lazy greedy on bounded rows, up to the first pick that does not go before ``bound`` (``-gain, prefer, item``)."""

    def picks_of(pdf: pd.DataFrame) -> pd.DataFrame:
        sets: dict = defaultdict(set)
        prefer = {}
        for p, item, env in zip(pdf["prefer"].tolist(), pdf["item"].tolist(), pdf["env"].tolist()):
            sets[item].add(env)
            prefer[item] = p
        heap = [(-len(s), prefer[k], k) for k, s in sets.items()]
        heapq.heapify(heap)
        done: set = set()
        picks = []
        while heap and (bound is None or heap[0] < bound):
            gain, p, k = heapq.heappop(heap)
            now = len(sets[k] - done)
            if now == -gain and now:
                picks.append((p, k, now))
                done |= sets[k]
            elif now:
                heapq.heappush(heap, (-now, p, k))
        return pd.DataFrame(picks, columns=["prefer", "item", "new_gain"])

    return picks_of


def _block(gains: DataFrame, finish: int) -> tuple[tuple | None, bool]:
    """Where the block of the largest gains ends (``-gain, prefer, item`` of the first item outside), and whether it
    holds any item. The block has at most ``finish`` incidences and ``BLOCK`` items."""
    top = gains.orderBy(F.desc("new_gain"), "prefer", "item").limit(BLOCK + 1).collect()
    held = 0
    for k, row in enumerate(top):
        held += row["new_gain"]
        if held > finish or k == BLOCK:
            return (-row["new_gain"], row["prefer"], row["item"]), k > 0
    return None, bool(top)


def greedy_picks(scratch: Scratch, inc: DataFrame, finish: int = FINISH) -> DataFrame:
    """``prefer, item, new_gain`` of the full greedy cover of ``inc(item, env[, prefer])``; smaller ``prefer`` wins ties."""
    if "prefer" not in inc.columns:
        inc = inc.withColumn("prefer", F.lit(0))
    rest = scratch.keep(inc.select("item", "env", F.col("prefer").cast("int").alias("prefer")).distinct())
    item_type = rest.schema["item"].dataType.simpleString()
    picks = []
    out_type = f"prefer int, item {item_type}, new_gain long"
    while left := rest.count():
        if left <= finish:
            picks.append(rest.groupBy(F.lit(0).alias("one")).applyInPandas(_lazy_greedy(), out_type))
            break
        gains = scratch.keep(rest.groupBy("item", "prefer").agg(F.count("*").alias("new_gain")))
        place = F.struct((-F.col("new_gain")).alias("g"), "prefer", "item")
        placed = rest.join(gains.select("item", "new_gain"), "item").select("item", "env", "prefer", "new_gain", place.alias("place"))
        firsts = placed.groupBy("env").agg(F.min("place").alias("first"))
        won = firsts.groupBy(F.col("first.item").alias("item"), F.col("first.prefer").alias("prefer"), (-F.col("first.g")).alias("new_gain")).agg(F.count("*").alias("wins"))
        won = won.where("wins = new_gain").select("prefer", "item", "new_gain")
        bound, has_block = _block(gains, finish)
        if has_block:
            inside = F.lit(True) if bound is None else F.col("place") < F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(bound, ("long", "int", item_type), ("g", "prefer", "item"))])
            block = placed.where(inside).select("prefer", "item", "env")
            won = won.unionByName(block.groupBy(F.lit(0).alias("one")).applyInPandas(_lazy_greedy(bound), out_type)).distinct()
        picked = scratch.keep(won)
        picks.append(picked)
        covered = rest.join(picked.select("item"), "item", "left_semi").select("env").distinct()
        before, rest = rest, scratch.keep(rest.join(covered, "env", "left_anti").select("item", "env", "prefer"))
        scratch.drop(before, gains)
    if not picks:
        return inc.select(F.col("prefer").cast("int").alias("prefer"), "item", F.lit(0).cast("long").alias("new_gain")).limit(0)
    out = picks[0]
    for more in picks[1:]:
        out = out.unionByName(more)
    return out


def greedy_cover(scratch: Scratch, inc: DataFrame, budget: int = 0, stop_pct: float = 100.0, finish: int = FINISH, target: int | None = None) -> DataFrame:
    """The manifest ``rank, item, new_gain, covered, uncovered, coverage_pct`` of a greedy cover.

    ``budget`` 0 is no limit. The cover ends with the first pick that reaches ``stop_pct`` (cut to 0..100) of the
    ``target`` envs, which at 0 is none; without ``target``, all envs that the relation has are the target. An empty
    relation gives an empty manifest.
    """
    picks = scratch.keep(greedy_picks(scratch, inc, finish))
    if target is None:
        # a full cover has every env once
        target = picks.agg(F.sum("new_gain")).first()[0] or 0
    ranked = global_rank(scratch, picks, [F.desc("new_gain"), F.asc("prefer"), F.asc("item")], "new_gain")
    pct = 100.0 * F.col("covered") / max(1, target)
    stop = min(100.0, max(0.0, stop_pct))
    ranked = ranked.where(100.0 * (F.col("covered") - F.col("new_gain")) / max(1, target) < stop)
    if budget:
        ranked = ranked.where(F.col("rank") <= budget)
    return ranked.select("rank", "item", "new_gain", F.col("covered"), (F.lit(target) - F.col("covered")).alias("uncovered"), pct.alias("coverage_pct"))


def _swept(with_partners: bool):
    """The sweep one by one, on bounded rows ``item, turn, envs, holders, partners``: ``item, stays``."""

    def swept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", ignore_index=True)
        items = pdf["item"].tolist()
        envs = [[] if e is None else list(e) for e in pdf["envs"]]
        holders = {e: n for es, ns in zip(envs, pdf["holders"]) for e, n in zip(es, [] if ns is None else ns)}
        gone: set = set()
        for item, own, near in zip(items, envs, pdf["partners"]):
            near = [] if near is None else near
            if all(holders[e] > 1 for e in own) and (not with_partners or any(p not in gone for p in near)):
                gone.add(item)
                for e in own:
                    holders[e] -= 1
        return pd.DataFrame({"item": pd.Series(items, dtype=pdf["item"].dtype), "stays": [k not in gone for k in items]})

    return swept


def _one_by_one(turns: DataFrame, rest: DataFrame, near: DataFrame | None) -> DataFrame:
    """``item, stays`` of the bounded ``turns(item, turn)``, who come before all other items of ``rest``."""
    own = rest.join(turns, "item", "left_semi").select("item", "env")
    counts = rest.join(own.select("env").distinct(), "env", "left_semi").groupBy("env").agg(F.count("*").alias("n"))
    own = own.join(counts, "env").groupBy("item").agg(F.collect_list(F.struct("env", "n")).alias("s"))
    rows = turns.join(own.select("item", F.col("s.env").alias("envs"), F.col("s.n").alias("holders")), "item", "left")
    pairs = turns.limit(0).select("item", F.col("item").alias("b")) if near is None else near.join(turns.select(F.col("item").alias("a")), "a", "left_semi").select(F.col("a").alias("item"), "b")
    rows = rows.join(pairs.groupBy("item").agg(F.collect_list("b").alias("partners")), "item", "left")
    item_type = turns.schema["item"].dataType.simpleString()
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(_swept(near is not None), f"item {item_type}, stays boolean")


def of_last_items(scratch: Scratch, rows: DataFrame, envs: DataFrame, on: str, place: Column) -> DataFrame:
    """The incidence of ``rows(item, on)`` joined with ``envs(on, env)``, of the items alone that are the last by
    ``place``, another for each item, to have some env. A sweep without partners keeps the same items of it as of all.

    The last item of a key stands for all its rows, as they have the same envs, so what is joined first is a row per
    key; the rows of the last items come second. No pair of an item and an env is made for the others.
    """
    placed = rows.where("item is not null").select("item", on, place.alias("place"))
    envs = envs.select(on, compared(F.col("env")).alias("env")).where("env <> ''")
    lasts = placed.groupBy(on).agg(F.max("place").alias("place")).join(envs, on).groupBy("env").agg(F.max("place").alias("place"))
    lasts = scratch.keep(lasts.select("place").distinct())
    return placed.join(small_side(lasts), "place", "left_semi").join(envs, on).select("item", "env").distinct()


def sweep(scratch: Scratch, inc: DataFrame, order: DataFrame, partners: DataFrame | None = None, finish: int = FINISH) -> DataFrame:
    """``item, place`` of what stays when items are looked at in the order of ``order(item, place)`` and one is
    removed if all its envs are in another remaining item (and, with ``partners(a, b)``, a partner remains).

    Decided at once: who alone has an env, or has no partner left, stays; an env of an item that stays binds nobody.
    Others go where a later undecided item has each of their binding envs, as it remains at their turn, and they come
    first among their partners. So without partners all but the last item of each env go before the first round. A
    round also takes the first undecided items, at most ``finish`` rows and ``BLOCK`` items, one by one in one task:
    who comes later remains whatever is decided on them. So does the end, once at most ``finish`` rows are left.
    """
    order = scratch.keep(order.select("item", "place"))
    placed = lambda: inc.select("item", "env").join(small_side(order, MOST_ORDER), "item")
    near = None
    if partners is None:
        # an item that is nowhere the last goes, and binds nobody, as the last remain until their turn
        lasts = placed().groupBy("env").agg(F.max("place").alias("place")).select("place").distinct()
        order = scratch.keep(order.join(lasts, "place", "left_semi").select("item", "place"))
    else:
        near = scratch.keep(partners.select("a", "b").unionByName(partners.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rest = scratch.keep(placed())
    undecided = order
    kept = order.limit(0)
    while left := undecided.count():
        if left + rest.count() + (0 if near is None else near.count()) <= finish:
            turns = undecided.select("item", F.row_number().over(Window.orderBy("place")).alias("turn"))
            stay = _one_by_one(turns, rest, near).where("stays").select("item")
            return kept.unionByName(undecided.join(stay, "item", "left_semi"))
        loads = rest.select("item") if near is None else rest.select("item").unionByName(near.select(F.col("a").alias("item")))
        loads = undecided.join(loads.groupBy("item").agg(F.count("*").alias("load")), "item", "left").na.fill(0, ["load"])
        head = loads.orderBy("place").limit(BLOCK)
        head = head.withColumns({"turn": F.row_number().over(Window.orderBy("place")), "held": F.sum(F.col("load") + 1).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))})
        block = scratch.keep(head.where(F.col("held") <= finish).select("item", "turn"))
        envs = rest.groupBy("env").agg(F.count("*").alias("n"), F.max("place").alias("last"))
        seen = rest.join(envs, "env").groupBy("item").agg(F.max(F.expr("n = 1")).alias("alone"), F.min(F.expr("place < last")).alias("spare"))
        rows = undecided.join(seen, "item", "left").na.fill(False, ["alone"]).na.fill(True, ["spare"])
        if near is None:
            rows = rows.withColumns({"has": F.lit(True), "waits": F.lit(False)})
        else:
            ahead = near.join(undecided.select(F.col("item").alias("a"), F.col("place").alias("place_a")), "a")
            ahead = ahead.join(undecided.select(F.col("item").alias("b"), F.col("place").alias("place_b")), "b", "left")
            ahead = ahead.groupBy(F.col("a").alias("item")).agg(F.lit(True).alias("has"), F.max(F.expr("place_b is not null and place_b < place_a")).alias("waits"))
            rows = rows.join(ahead, "item", "left").na.fill(False, ["has", "waits"])
        stays = F.expr("alone or not has")
        decided = rows.where(stays | F.expr("spare and not waits")).select("item", "place", stays.alias("stays"))
        in_block = undecided.join(_one_by_one(block, rest, near), "item").select("item", "place", "stays")
        decided = scratch.keep(decided.join(block, "item", "left_anti").unionByName(in_block))
        stay = decided.where("stays").select("item", "place")
        kept = kept.unionByName(stay)
        safe = rest.join(stay.select("item"), "item", "left_semi").select("env").distinct()
        before = [block, rest, undecided] if undecided is not order else [block, rest]
        rest = scratch.keep(rest.join(decided.select("item"), "item", "left_anti").join(safe, "env", "left_anti").select("item", "env", "place"))
        undecided = scratch.keep(undecided.join(decided.select("item"), "item", "left_anti"))
        if near is not None:
            before.append(near)
            near = scratch.keep(near.join(decided.where("not stays").select(F.col("item").alias("b")), "b", "left_anti").select("a", "b"))
        scratch.drop(*before)
    return kept


def two_tier_cover(scratch: Scratch, inc: DataFrame, target: DataFrame, universe: DataFrame, rare_most: int = 5, rare_overlap: float = 0.85, common_overlap: float = 0.70, band: float = 0.25, common_pct: float = 85.0, budget: int = 0, finish: int = FINISH) -> DataFrame:
    """``rank, item, pass_name, new_gain, covered, uncovered, coverage_pct``: rare envs in full, then common ones.

    Rarity is taken from the whole ``universe``. The rare pass knows no budget. Common envs that its picks have are
    taken off; the second pass leaves its picks out, collapses similar items by all common envs, and covers
    ``common_pct`` of all that remains, whether the items that stay have it or not.
    """
    tiers = scratch.keep(classify(universe, rare_most).join(target.select("env").distinct(), "env", "left_semi"))
    rare, common = tiers.where("tier = 'rare'").select("env"), tiers.where("tier = 'common'").select("env")
    first = scratch.keep(greedy_cover(scratch, deduplicated(scratch, projected(inc, rare), rare_overlap, band), finish=finish))
    hit = inc.join(first.select("item"), "item", "left_semi").select("env").distinct()
    left = scratch.keep(common.join(hit, "env", "left_anti"))
    pool = deduplicated(scratch, projected(inc, common, exclude=first.select("item")), common_overlap, band)
    second = greedy_cover(scratch, projected(pool, left), budget, common_pct, finish, left.count())
    passes = first.select("item", F.lit("rare").alias("pass_name"), F.col("rank").alias("r"), F.lit(1).alias("turn"))
    passes = passes.unionByName(second.select("item", F.lit("common").alias("pass_name"), F.col("rank").alias("r"), F.lit(2).alias("turn")))
    return manifest(scratch, passes, inc.join(target.select("env").distinct(), "env", "left_semi"), ["turn", "r"], ["pass_name"])


def manifest(scratch: Scratch, picks: DataFrame, inc: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """A manifest over all of ``inc`` for picks in a given order: an env is new where it is met first."""
    ranked = scratch.keep(global_rank(scratch, picks, [F.asc(c) for c in order]))
    firsts = inc.join(ranked.select("item", "rank"), "item").groupBy("env").agg(F.min("rank").alias("rank"))
    gains = firsts.groupBy("rank").agg(F.count("*").alias("new_gain"))
    rows = ranked.join(gains, "rank", "left").select("item", *keep, F.col("rank").alias("place"), F.coalesce("new_gain", F.lit(0)).alias("new_gain"))
    target = inc.select("env").distinct().count()
    rows = global_rank(scratch, rows, [F.asc("place")], "new_gain")
    return rows.select("rank", "item", *keep, "new_gain", "covered", (F.lit(target) - F.col("covered")).alias("uncovered"), (100.0 * F.col("covered") / max(1, target)).alias("coverage_pct"))


def without_similar(scratch: Scratch, inc: DataFrame, order: DataFrame, threshold: float = 0.85, band: float = 0.25) -> DataFrame:
    """``item, place`` of what stays when redundant items go that have a remaining similar item.

    Items without an env of their own are looked at by size, the largest first, then in order; the size ratio of
    similar items is at least ``1 - band``. A threshold of 0 or less, or above 1, changes nothing; items without envs
    have no similar ones and stay.
    """
    if threshold <= 0 or threshold > 1:
        return order.select("item", "place")
    chosen = scratch.keep(inc.join(order.select("item"), "item", "left_semi").select("item", "env"))
    # of equal sets all but the last in order go, whatever else happens: the last stands for their envs and partners
    copies = exact_copies(chosen).join(order, "item").groupBy("first").agg(F.max(F.struct("place", "item")).alias("last"))
    bare = order.select("item", "place").join(chosen.select("item"), "item", "left_anti")
    order = scratch.keep(copies.select("last.item", "last.place"))
    chosen = scratch.keep(chosen.join(order.select("item"), "item", "left_semi"))
    sets = token_sets(scratch, chosen)
    links = overlap_links(sets, threshold, None)
    sizes = sets.select("item", "n")
    links = links.join(sizes.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    links = links.where(F.least("na", "nb") >= (1 - band) * F.greatest("na", "nb")).select("a", "b")
    by_size = order.join(sizes, "item").select("item", F.struct((-F.col("n")).alias("size"), "place").alias("place"))
    stays = sweep(scratch, chosen, by_size, links)
    return order.join(stays.select("item"), "item", "left_semi").select("item", "place").unionByName(bare)
