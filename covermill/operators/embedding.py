"""Hashed vectors of type names, and their first two principal axes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.functions.scalar import hashed_slot, type_tokens


def hashed_vectors(types: DataFrame, dim: int = 128) -> DataFrame:
    """``type, slot, value``: words, numbers and trigrams of each type, hashed with signs, scaled to length 1.

    Slots that cancel out are left out; a type without tokens has no row.
    """
    rows = types.select("type").where("type is not null").distinct().select("type", F.explode(type_tokens(F.col("type"))).alias("token"))
    slot, sign = hashed_slot(F.col("token"), dim)
    rows = rows.groupBy("type", slot.alias("slot")).agg(F.sum(sign).alias("value")).where("value <> 0")
    norms = rows.groupBy("type").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rows.join(norms, "type").select("type", "slot", (F.col("value") / F.col("norm")).alias("value"))


def _moments(dim: int):
    def moments(batches):
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(float)
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "p": [p.reshape(-1)]})

    return moments


def principal_axes(points: DataFrame, dim: int) -> DataFrame:
    """``id, x, y``: ``points(id, x)`` on their first two principal axes, each with its largest loading positive.

    Each task adds up its sums and products, a table of ``dim * dim`` numbers, from which the driver takes the axes;
    the points are not gathered. Points of another length are left out; fewer than two points lie at the origin.
    """
    valid = points.select("id", F.col("x").cast("array<double>").alias("x")).where(F.size("x") == dim)
    parts = valid.select("x").mapInPandas(_moments(dim), "n long, s array<double>, p array<double>")
    flat = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "p")).alias("pos", "v"))
    sums = np.array([r["v"] for r in flat.groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()] or [0.0] * (1 + dim + dim * dim))
    n, s, p = sums[0], sums[1 : dim + 1], sums[dim + 1 :]
    mean = s / max(1, n)
    cov = p.reshape(dim, dim) / max(1, n) - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :2] if n > 1 else np.zeros((dim, 2))
    if axes.shape[1] < 2:
        axes = np.hstack([axes, np.zeros((dim, 2 - axes.shape[1]))])
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)

    def on(axis: np.ndarray):
        weights = F.array(*[F.lit(float(a)) for a in axis])
        shift = float(mean @ axis)
        return F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) - shift

    return valid.select("id", on(axes[:, 0]).alias("px"), on(axes[:, 1]).alias("py")).select("id", F.col("px").alias("x"), F.col("py").alias("y"))
