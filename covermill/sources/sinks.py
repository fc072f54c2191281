"""Writers: frames in order, manifests, reports, cluster indexes, spectra."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions.scalar import center_of, rcut_of, safe_name
from covermill.functions.signature import plain
from covermill.operators.metrics import report
from covermill.session import Scratch
from covermill.sources.xyz import frame_text


def write_frames(frames: DataFrame, order: DataFrame, key: list[str], path: str) -> None:
    """The frames named in ``order(*key, rank)``, their text as it was read, in rank order over the files' order."""
    rows = frames.join(order.select(*key, "rank"), key)
    if "raw_text" not in rows.columns:
        rows = frame_text(rows)
    rows.repartitionByRange(F.asc("rank")).sortWithinPartitions("rank").select("raw_text").write.mode("overwrite").text(path)


def write_mixed(probe: DataFrame, pool: DataFrame, order: DataFrame, path: str) -> None:
    """Frames of two sources in the order of ``order(source, source_idx, rank)``; frames have ``source_idx``."""
    cols = ["source_idx", "raw_text"]
    texts = [(df if "raw_text" in df.columns else frame_text(df)).select(*cols, F.lit(s).alias("source")) for df, s in ((probe, "probe"), (pool, "phase2"))]
    write_frames(texts[0].unionByName(texts[1]), order, ["source", "source_idx"], path)


def rejected(all_items: DataFrame, accepted: DataFrame, source: str, reason: str = "pair_distance_below_limit") -> DataFrame:
    """``source, source_idx, reason`` of what is not accepted."""
    rows = all_items.select("item").distinct().join(accepted.select("item"), "item", "left_anti")
    return rows.select(F.lit(source).alias("source"), F.col("item").alias("source_idx"), F.lit(reason).alias("reason"))


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables under the ordered union of their columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; nulls are empty."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def summary_json(one: DataFrame) -> str:
    """A one-row frame as JSON with sorted keys."""
    row = one.first()
    return json.dumps(plain(row.asDict(True) if row else {}), indent=2, sort_keys=True)


def write_report(one: DataFrame, path: str) -> None:
    write_csv(report(one), path, ["key", "value"])


def text_report(sections: dict[str, DataFrame]) -> str:
    """Titles with the keys and values of one-row frames; an empty frame has no section."""
    lines = []
    for title, one in sections.items():
        row = one.first()
        if row is None:
            continue
        lines += [title, "-" * len(title)]
        for k, v in row.asDict().items():
            lines.append(f"{k}: {v:,d}" if isinstance(v, int) and not isinstance(v, bool) else f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}")
        lines.append("")
    return "\n".join(lines)


def cluster_index(scratch: Scratch, rows: DataFrame, per_type: int = 0, overall: int = 0) -> DataFrame:
    """Index of exported environments from ``rows(type, raw, source_idx, i)``, by type and raw token.

    ``per_type`` and ``overall`` bound the export, 0 is no bound. Rows are range-partitioned and numbered inside their
    partition, plus what the partitions before hold of the type, so no task sorts all rows or all of a type.
    """
    order = ["type", "raw", "source_idx", "i"]
    parts = scratch.keep(rows.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("type", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("type", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = Window.partitionBy("type", "part").orderBy("raw", "source_idx", "i")
    ranked = parts.withColumn("r", F.row_number().over(own)).join(sizes, ["type", "part"]).withColumn("nth", F.col("r") + F.col("offset"))
    if per_type:
        ranked = ranked.where(F.col("nth") <= per_type)
    if overall:
        sizes = ranked.groupBy("type").agg(F.count("*").alias("n"))
        before = Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.join(sizes.select("type", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "type").where(F.col("before") + F.col("nth") <= overall)
    name = safe_name(F.concat_ws("_", "type", F.format_string("%05d", "nth")))
    return ranked.select(F.concat(name, F.lit(".cif")).alias("cif_file"), F.col("type").alias("effective_fp"), F.col("raw").alias("raw_fp"), "source_idx", F.col("i").alias("center_atom_index"), center_of(F.col("type")).alias("center_symbol"), rcut_of(F.col("type")).alias("rcut"))


def write_bands(points: DataFrame, path: str) -> None:
    """``x y`` lines of ``points(seg, ordinal, x, y)``, a blank line between segments."""
    last = F.max("ordinal").over(Window.partitionBy("seg"))
    line = F.format_string("%.8f %.8f", "x", "y")
    rows = points.withColumn("value", F.when(F.col("ordinal") == last, F.concat(line, F.lit("\n"))).otherwise(line))
    rows.repartitionByRange("seg", "ordinal").sortWithinPartitions("seg", "ordinal").select("value").write.mode("overwrite").text(path)


def write_thermal(rows: DataFrame, path: str) -> None:
    """Records of ``rows(temperature, free_energy, entropy, heat_capacity, energy)`` by temperature."""
    names = ("temperature", "free_energy", "entropy", "heat_capacity", "energy")
    lines = [F.format_string(f"{'- ' if n == 'temperature' else '  '}{n}: %.8f", n) for n in names]
    text = rows.repartitionByRange("temperature").sortWithinPartitions("temperature").select(F.concat_ws("\n", *lines, F.lit("")).alias("value"))
    text.write.mode("overwrite").text(path)


def cif_text(clusters: DataFrame) -> DataFrame:
    """``frame_id, i, cif``: the local clusters of ``geometry.cluster_atoms`` as CIF, a cube without symmetry."""
    ordered = F.array_sort(F.collect_list(F.struct("j", "symbol", "x", "y", "z"))).alias("atoms")
    rows = clusters.groupBy("frame_id", "i", "box").agg(ordered)
    cell = [F.format_string(f"_cell_length_{c} %.6f", "box") for c in "abc"] + [F.lit(f"_cell_angle_{c} 90") for c in ("alpha", "beta", "gamma")]
    loop = "loop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z"
    at = F.transform("atoms", lambda a, k: F.concat_ws(" ", F.concat(a["symbol"], (k + 1).cast("string")), a["symbol"], *[F.format_string("%.8f", a[n] / F.col("box")) for n in "xyz"]))
    head = F.concat_ws("\n", F.format_string("data_%d_%d", "frame_id", "i"), *cell, F.lit("_symmetry_space_group_name_H-M 'P 1'"), F.lit(loop))
    return rows.select("frame_id", "i", F.concat_ws("\n", head, F.array_join(at, "\n"), F.lit("")).alias("cif"))


def write_spectrum(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("freq").sortWithinPartitions("freq").select(F.format_string("%.8f %.8f", "freq", "dos").alias("value")).write.mode("overwrite").text(path)
