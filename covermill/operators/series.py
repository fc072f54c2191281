"""Trajectories, spectra and errors: distributions, displacement, correlation and comparison of series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions.scalar import det3
from covermill.operators.geometry import atoms_of, bond_angles, neighbours


def radial_distribution(frames: DataFrame, longest: float, width: float) -> DataFrame:
    """``kind, bin, r, n_pairs, g``: pairs by distance and species, against an even spread over the cell.

    ``g`` is the mean over the frames that have the pair's species.
    """
    atoms = atoms_of(frames)
    pairs = neighbours(frames, longest).where("i < j and distance > 0")
    kind = F.concat_ws("-", F.greatest("symbol_i", "symbol_j"), F.least("symbol_i", "symbol_j")).alias("kind")
    at = F.floor(F.col("distance") / width).cast("int").alias("bin")
    counted = pairs.select("frame_id", kind, at).groupBy("frame_id", "kind", "bin").agg(F.count("*").alias("n"))
    number = atoms.groupBy("frame_id", "symbol").agg(F.count("*").alias("n"), F.first(F.abs(det3(F.col("lattice")))).alias("volume"))
    a = number.select("frame_id", F.col("symbol").alias("sa"), F.col("n").alias("na"), "volume")
    b = number.select("frame_id", F.col("symbol").alias("sb"), F.col("n").alias("nb"))
    every = a.join(b, "frame_id").where("sa >= sb").withColumn("kind", F.concat_ws("-", "sa", "sb"))
    every = every.withColumn("possible", F.when(F.col("sa") == F.col("sb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))).where("possible > 0")
    low = F.col("bin") * width
    shell = 4 * math.pi / 3 * (F.pow(low + width, F.lit(3)) - F.pow(low, F.lit(3)))
    share = counted.join(every, ["frame_id", "kind"]).withColumn("g", F.col("n") * F.col("volume") / (F.col("possible") * shell))
    frames_of = every.groupBy("kind").agg(F.countDistinct("frame_id").alias("n_frames"))
    out = share.groupBy("kind", "bin").agg(F.sum("n").alias("n_pairs"), F.sum("g").alias("g")).join(frames_of, "kind")
    return out.select("kind", "bin", (low + width / 2).alias("r"), "n_pairs", (F.col("g") / F.col("n_frames")).alias("g"))


def angular_distribution(frames: DataFrame, rcut: float, width: float) -> DataFrame:
    """``kind, bin, n, share``: bond angles by species, ``share`` of all angles of the kind."""
    rows = bond_angles(neighbours(frames, rcut))
    at = F.least(F.floor(F.col("angle") / width), F.lit(math.ceil(180 / width) - 1)).cast("int").alias("bin")
    binned = rows.select("kind", at).groupBy("kind", "bin").agg(F.count("*").alias("n"))
    # a kind has one row per bin, so its window is small, and the neighbours are searched once
    return binned.select("kind", "bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("kind"))).alias("share"))


def mean_square_displacement(points: DataFrame, part: list[str], particle: str, time: str, coords: list[str], boxes: dict[str, str] | None = None) -> DataFrame:
    """``*part, time, msd, n`` against each particle's first point. With ``boxes`` (box edge by coordinate), steps are
    taken to the nearest image and added up, which unwraps the trajectory."""
    w = Window.partitionBy(*part, particle).orderBy(time)
    rows = points
    for c in coords:
        step = F.col(c) - F.lag(c).over(w)
        if boxes:
            step = step - F.col(boxes[c]) * F.rint(step / F.col(boxes[c]))
        rows = rows.withColumn(f"step_{c}", F.coalesce(step, F.lit(0.0)))
    moved = [F.sum(f"step_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in coords]
    rows = rows.withColumn("square", sum((m * m for m in moved), F.lit(0.0)))
    return rows.groupBy(*part, time).agg(F.avg("square").alias("msd"), F.count("*").alias("n"))


def volumes(frames: DataFrame) -> DataFrame:
    """``frame_id, step, volume``."""
    return frames.where("frame_id is not null and size(lattice) = 9").dropDuplicates(["frame_id"]).select("frame_id", "step", F.abs(det3(F.col("lattice"))).alias("volume"))


def interpolated(series: DataFrame, grid: DataFrame, part: list[str]) -> DataFrame:
    """``*part, x, y``: ``series(*part, x, y)`` at the points of ``grid(*part, x)`` inside its range, linearly between
    the points around. Repeated points of a series are averaged; null points are left out."""
    points = series.where("x is not null and y is not null").groupBy(*part, "x").agg(F.avg("y").alias("y"))
    rows = points.select(*part, "x", "y", F.lit(False).alias("asked")).unionByName(grid.where("x is not null").select(*part, "x", F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked")).distinct())
    w = Window.partitionBy(*part).orderBy("x", "asked")
    known = F.when(~F.col("asked"), F.struct("x", "y"))
    rows = rows.withColumn("lo", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("hi", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("asked")
    exact = F.col("lo.x") == F.col("x")
    slope = (F.col("hi.y") - F.col("lo.y")) / (F.col("hi.x") - F.col("lo.x"))
    value = F.when(exact, F.col("lo.y")).when(F.col("hi.x") > F.col("lo.x"), F.col("lo.y") + slope * (F.col("x") - F.col("lo.x")))
    return rows.select(*part, "x", value.alias("y")).where("y is not null")


def correlation(left: DataFrame, right: DataFrame, part: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """``*part, n, pearson`` of two series: the right one is taken at the left one's points, inside the window."""
    points = left.where("x is not null and y is not null").groupBy(*part, "x").agg(F.avg("y").alias("y"))
    if low is not None:
        points = points.where(F.col("x") >= low)
    if high is not None:
        points = points.where(F.col("x") <= high)
    other = interpolated(right, points.select(*part, "x"), part).withColumnRenamed("y", "z")
    return points.join(other, [*part, "x"]).groupBy(*part).agg(F.count("*").alias("n"), F.corr("y", "z").alias("pearson"))


def mean_absolute_errors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, energy_mae, force_mae, stress_mae`` of frames of two sources; a missing value on a side gives null.

    Energies are per atom, forces per component over the atoms, stresses per component.
    """
    side = lambda df, s: df.where(F.col(key).isNotNull()).dropDuplicates([key]).select(key, *[F.col(c).alias(f"{c}_{s}") for c in ("energy", "stress", "atoms")])
    both = side(left, "l").join(side(right, "r"), key)
    energy = F.when(~F.isnan("energy_l") & ~F.isnan("energy_r"), F.abs(F.col("energy_l") - F.col("energy_r")) / F.greatest(F.lit(1), F.size("atoms_l")))
    mean = "aggregate({0}, 0D, (s, v) -> s + abs(v)) / size({0})"
    diff = "flatten(zip_with(atoms_l, atoms_r, (p, q) -> zip_with(p.forces, q.forces, (a, b) -> cast(a - b as double))))"
    stress = "zip_with(stress_l, stress_r, (a, b) -> cast(a - b as double))"
    return both.select(key, energy.alias("energy_mae"), F.expr(mean.format(diff)).alias("force_mae"), F.expr(mean.format(stress)).alias("stress_mae"))


def correlations(rows: DataFrame, part: list[str], kind: str) -> DataFrame:
    """``*part, kind_a, kind_b, n, pearson`` of every two series ``kind_a < kind_b`` of a part of ``rows(*part, kind,
    x, y)``: the second is taken at the points of the first."""
    points = rows.where("x is not null and y is not null").groupBy(*part, kind, "x").agg(F.avg("y").alias("y"))
    kinds = points.select(*part, kind).distinct()
    pairs = kinds.withColumnRenamed(kind, "kind_a").join(kinds.withColumnRenamed(kind, "kind_b"), part).where("kind_a < kind_b")
    left, right = (pairs.join(points.withColumnRenamed(kind, k), [*part, k]).select(*part, "kind_a", "kind_b", "x", "y") for k in ("kind_a", "kind_b"))
    return correlation(left, right, [*part, "kind_a", "kind_b"])


def compared_series(left: DataFrame, right: DataFrame, on: str | list[str], values: list[str]) -> DataFrame:
    """Full join on ``on`` with ``<value>_left, <value>_right, <value>_diff``."""
    keys = [on] if isinstance(on, str) else on
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values])
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values])
    return a.join(b, keys, "full").select(*keys, *[c for v in values for c in (F.col(f"{v}_left"), F.col(f"{v}_right"), (F.col(f"{v}_left") - F.col(f"{v}_right")).alias(f"{v}_diff"))])


def last_values(log: DataFrame, run: str, step: str, values: list[str]) -> DataFrame:
    """``run, last_step`` and each value at the run's last step with its change since the step before."""
    w = Window.partitionBy(run).orderBy(step)
    rows = log.where(F.col(step).isNotNull())
    for v in values:
        rows = rows.withColumn(f"change_{v}", F.col(v) - F.lag(v).over(w))
    picks = [F.max_by(c, step).alias(c) for v in values for c in (v, f"change_{v}")]
    return rows.groupBy(run).agg(F.max(step).alias("last_step"), *picks)


def zero_points(thermal: DataFrame, part: list[str]) -> DataFrame:
    """``*part, zpe, lowest, n``: the free energy at the lowest temperature of each record set, that temperature, and
    the number of records; null temperatures and energies are left out."""
    rows = thermal.where("temperature is not null and free_energy is not null")
    return rows.groupBy(*part).agg(F.min_by("free_energy", "temperature").alias("zpe"), F.min("temperature").alias("lowest"), F.count("*").alias("n"))
