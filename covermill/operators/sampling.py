"""Deterministic samples: strides over curves, types and frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.operators.cover import global_rank
from covermill.session import Scratch


def every_nth(df: DataFrame, step: str, n: int) -> DataFrame:
    """Rows whose step is a multiple of ``n``; null steps are left out."""
    return df.where(F.col(step) % n == 0)


def systematic(scratch: Scratch, names: DataFrame, most: int) -> DataFrame:
    """``name`` of at most ``most`` of ``names(name, priority)``, all if they are no more or ``most`` is 0 or less.

    Names with priority are all taken and the others at a stride that fits; where the former alone are ``most`` or
    more, they are taken at a stride and the others not at all. Null names are left out.
    """
    rows = names.where("name is not null").groupBy("name").agg(F.coalesce(F.max("priority"), F.lit(False)).alias("priority"))
    sizes = {r["priority"]: r["n"] for r in rows.groupBy("priority").agg(F.count("*").alias("n")).collect()}
    first, others = sizes.get(True, 0), sizes.get(False, 0)
    if most <= 0 or first + others <= most:
        return rows.select("name")
    if first >= most:
        return _strided(scratch, rows.where("priority"), math.ceil(first / most))
    rest = _strided(scratch, rows.where("not priority"), math.ceil(others / (most - first)))
    return rows.where("priority").select("name").unionByName(rest)


def _strided(scratch: Scratch, rows: DataFrame, stride: int) -> DataFrame:
    ranked = global_rank(scratch, rows, [F.asc("name")])
    return ranked.where((F.col("rank") - 1) % stride == 0).select("name")


def curve_points(ranked: DataFrame, rank: str, most: int) -> DataFrame:
    """Rows at a stride over the ranks and the last; at most about ``most`` of them."""
    last = ranked.agg(F.max(rank)).first()[0] or 0
    stride = max(1, math.ceil(last / max(1, most - 1)))
    return ranked.where((F.col(rank) % stride == 0) | (F.col(rank) == last))
