"""Problem 2: all similar pairs between set-valued records, by a prefix-filtered join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.records import Classes, Threshold, by_rarity, verified
from covermill.session import Scratch


def prefix_rows(ranked: DataFrame, t: Threshold) -> DataFrame:
    """The index: one row for each of a set's rarest ``n - least + 1`` tokens, with its position."""
    rarest = F.expr(f"slice(tokens, 1, n - {t.least('n')} + 1)")
    return ranked.select("id", "n", "parity", F.posexplode(rarest).alias("pos", "token"))


def class_pairs(scratch: Scratch, sets: DataFrame, t: Threshold) -> DataFrame:
    """Pairs ``a < b`` of classes that reach the threshold.

    Two sets that reach it share a token of both prefixes. A shared token at positions ``i`` and ``j`` leaves room
    for at most ``min(i, j) + 1 + min(rest)`` shared tokens; sizes, room and parity thin the candidates before the
    exact overlap is taken.
    """
    rows = scratch.keep(prefix_rows(by_rarity(scratch, sets), t))
    room = "least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos)"
    met = rows.alias("x").join(
        rows.alias("y"),
        F.expr(f"x.token = y.token and x.id < y.id and {t.may_pass('x', 'y')} and {room} >= {t.common('x.n', 'y.n')}"),
    )
    candidates = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return verified(candidates, sets, t)


def similar_pairs(scratch: Scratch, found: Classes, t: Threshold) -> DataFrame:
    """All pairs ``a < b`` of records that reach the threshold: those of one class, and those of similar classes.

    The output holds every pair, so a group of ``g`` copies gives ``g * (g - 1) / 2`` rows; before that it costs one
    (see ``class_pairs``, which with ``Classes.members`` says the same in fewer rows). Records without values are in
    no pair.
    """
    across = class_pairs(scratch, found.sets, t).select("a", "b")
    alone = found.members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1")
    classes = across.unionByName(alone.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    left = found.members.select(F.col("rep").alias("a"), F.col("id").alias("id_a"))
    right = found.members.select(F.col("rep").alias("b"), F.col("id").alias("id_b"))
    rows = classes.join(left, "a").join(right, "b").where("a <> b or id_a < id_b")
    return rows.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
