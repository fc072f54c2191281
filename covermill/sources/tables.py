"""Readers of small text formats: cells, k-paths, logs, spectra, thermal and error tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file with a header, all text; ``None`` where there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.csv(path, header=True)


def read_log(spark: SparkSession, path: str, n_values: int = 9) -> DataFrame:
    """``path, gen, c1..c<n>`` of white-space tables without header; blank and broken lines are left out."""
    parts = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("p"))
    rows = parts.where(F.size("p") == n_values + 1)
    return rows.select("path", F.col("p")[0].try_cast("double").cast("int").alias("gen"), *[F.col("p")[i].try_cast("double").alias(f"c{i}") for i in range(1, n_values + 1)]).where("gen is not null")


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """``path, freq, dos``; lines that start with ``#`` and blank lines are left out."""
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("v")).where("v <> '' and v not like '#%'")
    parts = rows.select("path", F.split("v", r"\s+").alias("p"))
    return parts.select("path", F.col("p")[0].cast("double").alias("freq"), F.col("p")[1].cast("double").alias("dos"))


def read_thermal(spark: SparkSession, path: str) -> DataFrame:
    """``path, temperature, free_energy, entropy, heat_capacity, energy`` of each record, blank lines or not."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.split("value", r"(?m)^\s*-\s*(?=temperature:)")).alias("record"))
    rows = files.where(F.col("record").rlike(r"^temperature:"))
    value = lambda name: F.regexp_extract("record", rf"(?m)^\s*{name}:\s*([-+0-9.eE]+)", 1).cast("double").alias(name)
    return rows.select("path", *[value(n) for n in ("temperature", "free_energy", "entropy", "heat_capacity", "energy")])


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """``index, energy_MAE, force_MAE, stress_MAE``; unnamed columns at the end are left out."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("index").cast("int").alias("index"), *[F.col(c).cast("double").alias(c) for c in ("energy_MAE", "force_MAE", "stress_MAE")])


def read_poscar(spark: SparkSession, path: str) -> DataFrame:
    """``path, comment, lattice, atoms(symbol, pos)``: scale times lattice, species by their counts, Cartesian or
    direct coordinates; positions come out Cartesian."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("l"))
    words = lambda i: F.filter(F.split(F.trim(F.col("l")[i]), r"\s+"), lambda x: x != "")
    rows = lines.select("path", "l", F.trim(F.col("l")[0]).alias("comment"), F.trim(F.col("l")[1]).cast("double").alias("scale"), *[F.transform(words(2 + k), lambda x: x.cast("double")).alias(f"v{k}") for k in range(3)], words(5).alias("species"), F.transform(words(6), lambda x: x.cast("int")).alias("counts"), F.lower(F.substring(F.trim(F.col("l")[7]), 1, 1)).alias("mode"))
    rows = rows.withColumn("cell", F.transform(F.concat("v0", "v1", "v2"), lambda x: x * F.col("scale")))
    rows = rows.withColumn("symbols", F.expr("flatten(zip_with(species, counts, (s, n) -> array_repeat(s, n)))"))
    coords = F.expr("transform(slice(l, 9, size(symbols)), x -> transform(slice(split(trim(x), '\\\\s+'), 1, 3), v -> cast(v as double)))")
    rows = rows.withColumn("coords", coords)
    direct = ", ".join(f"c[0] * cell[{k}] + c[1] * cell[{3 + k}] + c[2] * cell[{6 + k}]" for k in range(3))
    pos = F.expr(f"transform(coords, c -> if(mode = 'd', array({direct}), transform(c, x -> x * scale)))")
    rows = rows.withColumn("pos", pos)
    return rows.select("path", "comment", F.col("cell").alias("lattice"), F.expr("zip_with(symbols, pos, (s, p) -> struct(s as symbol, p as pos))").alias("atoms"))


def kpath_segments(text: str, per_segment: int = 100, commas_split: bool = False) -> tuple[list[dict], list[str]]:
    """Segments ``start, end, connected`` and merged labels of a k-path file.

    Lines that end in a backslash go on. ``|`` ends a sub-path; commas are blanks, or with ``commas_split`` end a
    sub-path too. Labels must be as many as points; where sub-paths meet, their labels become ``A|B``.
    """
    joined = re.sub(r"\\\s*\n", " ", text)
    entries = dict(re.findall(r"^\s*([A-Z_]+)\s*=\s*(.*?)\s*$", "\n".join(x.split("#")[0] for x in joined.splitlines()), re.M))
    if "BAND" not in entries:
        raise ValueError("no BAND entry")
    band = entries["BAND"].replace(";", " ")
    paths = []
    for part in re.split(r"[|,]" if commas_split else r"\|", band):
        numbers = [float(v) for v in part.replace(",", " ").split()]
        if len(numbers) % 3 or len(numbers) < 6:
            raise ValueError("a sub-path needs two points or more, of three numbers each")
        paths.append([numbers[i : i + 3] for i in range(0, len(numbers), 3)])
    labels = entries.get("BAND_LABELS", "").replace("|", " ").replace(",", " ").split()
    points = sum(map(len, paths))
    if labels and len(labels) != points:
        raise ValueError(f"{len(labels)} labels for {points} points")
    segments, merged, at = [], [], 0
    for n, path in enumerate(paths):
        for k in range(len(path) - 1):
            segments.append({"start": path[k], "end": path[k + 1], "connected": k > 0, "n": per_segment})
        own = labels[at : at + len(path)]
        at += len(path)
        if own and n and merged:
            merged[-1] = merged[-1] if merged[-1] == own[0] else f"{merged[-1]}|{own[0]}"
            own = own[1:]
        merged += own
    return segments, merged


def kpath_points(spark: SparkSession, text: str, per_segment: int = 100, commas_split: bool = False) -> DataFrame:
    """``seg, ordinal, k, connected``: evenly spaced points of each segment, ends included."""
    segments, _ = kpath_segments(text, per_segment, commas_split)
    rows = spark.createDataFrame([(i, s["start"], s["end"], s["connected"], s["n"]) for i, s in enumerate(segments)], "seg int, a array<double>, b array<double>, connected boolean, n int")
    rows = rows.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("ordinal"))
    return rows.select("seg", "ordinal", F.expr("zip_with(a, b, (p, q) -> p + (q - p) * ordinal / (n - 1))").alias("k"), "connected")
