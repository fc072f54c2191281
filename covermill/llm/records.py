"""Set-valued records: tokens per record, classes of equal sets, rarity order, exact overlap.

A record's values become 64-bit tokens (``xxhash64`` of the compared form), so that sets travel as arrays of longs.
Two different values get one token with a chance of about ``v * v / 2**65`` for ``v`` distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.functions.scalar import compared
from covermill.session import Scratch

#: A token in more than one of so many incidences is a hot key; there are fewer than this number of them.
HOT_SHARE = 4096


def record_sets(df: DataFrame, record: str, value: str, unit: str | None = None) -> DataFrame:
    """One row per record with a value: ``id, n, parity, sig, tokens``, tokens in the order of their numbers.

    With ``unit``, a value counts once per unit and a record's set holds ``(value, 1) ... (value, count)``, so that
    plain overlap of the sets is the overlap of the counted values. Null and blank values do not count; a null unit is
    a unit; records with a null id, or no value left, have no row. ``parity`` has bit ``token % 64`` flipped once per
    token: the bits in which two records differ are a lower bound of the number of tokens that only one of them has.
    """
    units = [] if unit is None else [F.col(unit).alias("unit")]
    plain = df.select(F.col(record).alias("id"), F.col(value).alias("value"), *units).where("id is not null and value is not null")
    rows = plain.withColumn("value", compared(F.col("value"))).where("value <> ''").withColumn("token", F.xxhash64("value"))
    # collect_set combines on the map side, so repeated rows are not shuffled
    if units:
        items = rows.groupBy("id").agg(F.collect_set(F.struct("token", "unit")).alias("items")).select("id", F.explode("items.token").alias("token"))
        items = items.groupBy("id", "token").agg(F.count("*").alias("times"))
        items = items.select("id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"), "token")
        sets = items.groupBy("id").agg(F.sort_array(F.collect_list(F.xxhash64("token", "turn"))).alias("tokens"))
    else:
        sets = rows.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    parity = F.expr("aggregate(tokens, 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int)))")
    return sets.select("id", F.size("tokens").alias("n"), parity.alias("parity"), F.xxhash64("tokens").alias("sig"), "tokens")


@dataclass
class Classes:
    """Records with equal sets are one class, named by its smallest record id.

    ``sets``: ``id, n, parity, sig, tokens``, one row per class. ``members``: ``id, rep``, one row per record.
    """

    sets: DataFrame
    members: DataFrame


def classes(scratch: Scratch, sets: DataFrame, within: tuple[str, ...] = ()) -> Classes:
    """Collapses copies, so that a group of copies of any size costs one row in all later steps. With ``within``, only
    records with equal values of these columns too are copies, and both tables lie in folders by them; without, the sets
    lie in buckets by id, so that later joins do not shuffle them."""
    kept = scratch.keep(sets)
    key = [*within, "sig", "parity", "n"]
    reps = kept.groupBy(*key).agg(F.min("id").alias("rep"))
    members = scratch.keep(kept.select("id", *key).join(reps, key).select("id", "rep", *within), within)
    one = kept.join(members.where("id = rep").select("id", *within), ["id", *within], "left_semi")
    one = scratch.keep(one, within) if within else scratch.keep_by(one, "id")
    scratch.drop(kept)
    return Classes(one, members)


def by_rarity(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """``id, n, parity, tokens`` with the rarest tokens first, by exact counts over all sets, equals by number.

    Counts are joined by token. The fewer than ``HOT_SHARE`` hot tokens are broadcast, so no task gets all rows of one;
    the counts of the others, however many there are, are shuffled.
    """
    rows = sets.select("id", F.explode("tokens").alias("token"))
    counts = scratch.keep(rows.groupBy("token").agg(F.count("*").alias("load")))
    most = (counts.agg(F.sum("load")).first()[0] or 0) // HOT_SHARE
    hot, others = counts.where(F.col("load") > most), counts.where(F.col("load") <= most)
    marked = rows.join(F.broadcast(hot), "token", "left")
    loaded = marked.where("load is not null").select("id", "token", "load")
    loaded = loaded.unionByName(marked.where("load is null").select("id", "token").join(others, "token"))
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    grouped = loaded.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.bit_xor(bit).alias("parity"), F.sort_array(F.collect_list(F.struct("load", "token"))).alias("s"))
    return grouped.select("id", "n", "parity", F.col("s.token").alias("tokens"))


@dataclass(frozen=True)
class Threshold:
    """The overlap ``num / den`` (both divided by either) that a pair must reach, in whole numbers."""

    num: int
    den: int

    def least(self, n: str) -> str:
        """SQL: tokens that a set of size ``n`` must share with any partner."""
        return f"cast(ceil({self.num}D * {n} / {self.den} - 1e-9) as int)"

    def most(self, n: str) -> str:
        """SQL: size of the largest partner of a set of size ``n``."""
        return f"cast(floor({n} * {self.den}D / {self.num} + 1e-9) as int)"

    def common(self, n: str, m: str) -> str:
        """SQL: tokens that sets of sizes ``n`` and ``m`` must share."""
        return f"cast(({self.num}L * ({n} + {m}) + {self.num + self.den - 1}L) div {self.num + self.den}L as int)"

    def apart(self, n: str, m: str) -> str:
        """SQL: most tokens that only one of the two may have; negative where the sizes rule the pair out."""
        return f"({n} + {m} - 2 * {self.common(n, m)})"

    def may_pass(self, a: str, b: str) -> str:
        """SQL: size and parity leave the pair possible; true for every pair that reaches the threshold."""
        return f"bit_count({a}.parity ^ {b}.parity) <= {self.apart(f'{a}.n', f'{b}.n')}"

    def reached(self, shared: str, n: str, m: str) -> str:
        """SQL: whether sets of sizes ``n`` and ``m`` with so many shared tokens reach the threshold."""
        return f"{self.den}L * {shared} >= {self.num}L * ({n} + {m} - {shared})"


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold, right: DataFrame | None = None) -> DataFrame:
    """The pairs ``(a, b)`` whose exact overlap reaches the threshold, with ``shared, n_a, n_b``; ``b`` is a record of
    ``right``, if given."""
    named = lambda df, x: df.select(F.col("id").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.select("a", "b").join(named(sets, "a"), "a").join(named(sets if right is None else right, "b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("shared"), F.size("tokens_a").alias("n_a"), F.size("tokens_b").alias("n_b"))
    return both.where(t.reached("shared", "n_a", "n_b"))
