"""Extended-XYZ frames as a Python data source, and frames written as text.

A file is split into byte ranges; a frame belongs to the range in which its count line starts. A range finds its first
frame whatever the comment lines hold: atom lines have more than one column, and the line before a comment is a count,
so a line with nothing but a whole number whose line before is another kind of line is a count. A range that begins
within such lines looks back to where they begin.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "path string, offset long, n_atoms int, lattice array<double>, properties string, stress array<double>, energy double, pbc array<boolean>, "
    "step long, props map<string,string>, atoms array<struct<symbol:string,pos:array<double>,forces:array<double>>>, raw_text string"
)
_ENTRY = re.compile(r'([A-Za-z_]\w*)=("[^"]*"|\S+)')
_COUNT = re.compile(rb"\s*(\d+)\s*$")
RANGE_BYTES = 64 << 20
#: Lines of frames in an Arrow batch, about.
BATCH_LINES = 20_000


def header_entries(line: str) -> dict[str, str]:
    return {k: v.strip('"') for k, v in _ENTRY.findall(line)}


def _numbers(text: str | None) -> list[float] | None:
    return None if text is None else [float(v) for v in text.split()]


def parse_frame(lines: list[str]) -> dict:
    """A frame of its count line, comment line and atom lines; columns follow the ``Properties`` of its comment."""
    entries = header_entries(lines[1])
    layout = entries.get("Properties", "species:S:1:pos:R:3").split(":")
    columns, at = {}, 0
    for name, _, n in zip(layout[::3], layout[1::3], layout[2::3]):
        columns[name] = slice(at, at + int(n))
        at += int(n)
    atoms = []
    for line in lines[2:]:
        parts = line.split()
        if len(parts) < at:
            raise ValueError(f"atom line with {len(parts)} of {at} columns: {line!r}")
        species = parts[columns["species"]][0] if "species" in columns else None
        pos = [float(v) for v in parts[columns["pos"]]] if "pos" in columns else None
        force_name = "forces" if "forces" in columns else "force"
        forces = [float(v) for v in parts[columns[force_name]]] if force_name in columns else None
        atoms.append({"symbol": species, "pos": pos, "forces": forces})
    known = ("Lattice", "Properties", "stress", "energy", "pbc", "step")
    return {
        "n_atoms": int(lines[0]), "lattice": _numbers(entries.get("Lattice")), "properties": entries.get("Properties"), "stress": _numbers(entries.get("stress")),
        "energy": float(entries["energy"]) if "energy" in entries else None, "pbc": [v.upper().startswith("T") for v in entries["pbc"].split()] if "pbc" in entries else None,
        "step": int(float(entries["step"])) if "step" in entries else None, "props": [(k, v) for k, v in entries.items() if k not in known], "atoms": atoms,
    }


def _before(handle, start: int, chunk: int = 1 << 16) -> int:
    """The last place up to ``start`` or the line after it whose line before is no lone whole number (or the file's
    begin): what is read from there on is read from the begin of a frame's count, or from inside of a frame."""
    while start:
        low = max(0, start - chunk)
        handle.seek(low)
        block = handle.read(start - low)
        begins = [low + i + 1 for i, c in enumerate(block[:-1]) if c == 10]
        for at in reversed([0, *begins] if low == 0 else begins):
            handle.seek(at)
            line = handle.readline()
            if not _COUNT.match(line):
                return at + len(line)
        if low == 0:
            return 0
        chunk *= 2
    return 0


def frames_in(handle, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    """Offset and lines of the frames whose count line starts in ``start..end``; blank lines between frames are
    skipped; a bad count, an unfinished frame or an atom line with nothing but a whole number raises."""
    at = _before(handle, start)
    handle.seek(at)
    synced = at == 0
    while True:
        at, line = handle.tell(), handle.readline()
        if not line or at >= end:
            return
        count = _COUNT.match(line)
        if not count:
            if synced and line.strip():
                raise ValueError(f"no atom count at byte {at}: {line!r}")
            continue
        synced = True
        lines = [line, handle.readline()]
        if not lines[1]:
            raise ValueError(f"end of file after the count at byte {at}")
        lines += [handle.readline() for _ in range(int(count[1]))]
        if not all(lines[2:]):
            raise ValueError(f"end of file inside the frame at byte {at}")
        if any(map(_COUNT.match, lines[2:])):
            raise ValueError(f"an atom line without a position in the frame at byte {at}")
        if at >= start:
            yield at, [x.decode("utf-8", errors="replace").rstrip("\r\n") for x in lines]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.path, self.range = schema, options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def _files(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return system, [info]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return system, sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

    def partitions(self):
        _, files = self._files()
        return [_Range(f.path, a, min(f.size, a + self.range)) for f in files for a in range(0, f.size, self.range)] or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        system, _ = self._files()
        with system.open_input_file(partition.path) as raw:
            rows, size = [], 0
            for at, lines in frames_in(io.BufferedReader(raw), partition.start, partition.end):
                rows.append(parse_frame(lines) | {"path": partition.path, "offset": at, "raw_text": "\n".join(lines)})
                size += len(lines)
                if size > BATCH_LINES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class XyzDataSource(DataSource):
    """``spark.read.format("xyz").load(path)``; ``path`` and ``offset`` are a frame's place."""

    @classmethod
    def name(cls):
        return "xyz"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(schema, self.options)


def read_xyz(spark, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of a file or folder. The path is read by the rules of the session's file systems, so one without a
    scheme lies in the default one; tasks open it by its full name."""
    spark.dataSource.register(XyzDataSource)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path))
    return spark.read.format("xyz").option("rangebytes", str(range_bytes)).load(path)


def wanted_frames(frames: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Frames named in ``wanted(key)``; raises with the first ten names that no frame has."""
    missing = wanted.select(key).distinct().join(frames.select(key), key, "left_anti").orderBy(key).limit(10).collect()
    if missing:
        raise ValueError(f"frames not found: {[r[0] for r in missing]}")
    return frames.join(wanted.select(key).distinct(), key, "left_semi")


def frame_text(frames: DataFrame) -> DataFrame:
    """``frames`` with ``raw_text``: count, comment and atom lines of each frame. Missing entries are left out."""
    entry = lambda name, value, test: F.when(test, F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")
    numbers = lambda c: F.array_join(F.transform(F.col(c), lambda v: v.cast("string")), " ")
    head = F.concat(
        F.lit('Properties="species:S:1:pos:R:3:forces:R:3"'),
        entry("Lattice", numbers("lattice"), F.col("lattice").isNotNull()),
        entry("stress", numbers("stress"), F.col("stress").isNotNull()),
        entry("energy", F.col("energy").cast("string"), F.col("energy").isNotNull() & ~F.isnan("energy")),
        entry("pbc", F.array_join(F.transform(F.col("pbc"), lambda v: F.when(v, "T").otherwise("F")), " "), F.col("pbc").isNotNull()),
        entry("step", F.col("step").cast("string"), F.col("step").isNotNull()),
    )
    three = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), " ")
    lines = F.transform("atoms", lambda a: F.concat_ws(" ", a["symbol"], three(a["pos"]), three(a["forces"])))
    return frames.withColumn("raw_text", F.array_join(F.concat(F.array(F.size("atoms").cast("string"), head), lines), "\n"))
