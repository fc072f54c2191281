import pytest

from covermill.functions.signature import signature
from covermill.operators import metrics
from covermill.plans import queries
from covermill.plans.stages import StageStore
from covermill.session import Scratch
from covermill.sources import sinks, tables, xyz

TEXT = """2
Lattice="5 0 0 0 5 0 0 0 5" Properties=species:S:1:pos:R:3:forces:R:3 energy=-1.5 pbc="T T F" step=200 tag=x
Fe 0 0 0 1 2 3
C 1 1 1 4 5 6

1
Properties=species:S:1:pos:R:3 energy=2
C 0.5 0 0
"""


def test_xyz_ranges(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.xyz").write_text(TEXT * 20)
    for size in (37, 301, 1 << 20):
        rows = xyz.read_xyz(spark, str(tmp_path), size).orderBy("path", "offset").collect()
        assert len(rows) == 120
    a, b = rows[:2]
    assert (a["n_atoms"], a["energy"], a["pbc"], a["step"], a["props"]) == (2, -1.5, [True, True, False], 200, {"tag": "x"})
    assert a["atoms"][1]["forces"] == [4.0, 5.0, 6.0] and b["atoms"][0]["forces"] is None and b["lattice"] is None
    frames = xyz.read_xyz(spark, str(tmp_path / "f0.xyz"))
    order = frames.orderBy("offset").limit(2).selectExpr("offset", "cast(1 - offset as long) as rank")
    sinks.write_frames(frames, order, ["offset"], str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=False).count() == 7
    with pytest.raises(ValueError, match="not found"):
        xyz.wanted_frames(frames, spark.createDataFrame([(-1,)], "offset long"), "offset")


COMMENTS = {"plain": "frame of a run", "blank": "", "number": "7", "entries": 'energy=1.5 step=3', "many": "1 2 3 4 5"}


@pytest.mark.parametrize("comment", COMMENTS)
def test_ranges_of_any_size_give_the_same_frames(comment, tmp_path):
    lines = []
    for k in range(60):
        n = (0, 1, 3, 2, 6)[k % 5]
        lines += [str(n), COMMENTS[comment] or "", *[f"Fe {k} {i} 0" for i in range(n)], *([""] if k % 7 == 0 else [])]
    path = tmp_path / "f.xyz"
    path.write_text("\n".join(lines) + "\n")
    size = path.stat().st_size
    with open(path, "rb") as f:
        whole = list(xyz.frames_in(f, 0, size))
        assert len(whole) == 60
        for step in (1, 7, 23, 100, 500):
            assert [x for a in range(0, size, step) for x in xyz.frames_in(f, a, a + step)] == whole, step


@pytest.mark.parametrize("text", ["x\nProperties=species:S:1:pos:R:3\n", "3\nProperties=species:S:1:pos:R:3\nC 0 0 0\n", "1\n", "2\nProperties=Z:I:1\n26\n26\n"])
def test_xyz_bad(text, tmp_path):
    (tmp_path / "bad.xyz").write_text(text)
    with open(tmp_path / "bad.xyz", "rb") as f, pytest.raises(ValueError):
        list(xyz.frames_in(f, 0, 1 << 20))


def test_kpath():
    segments, labels = tables.kpath_segments("BAND = 0 0 0  0.5 0 0 | 0 0 0, \\\n 0 0.5 0\nBAND_LABELS = G X G Y # end\n", 3)
    assert len(segments) == 2 and labels == ["G", "X|G", "Y"]
    with pytest.raises(ValueError):
        tables.kpath_segments("BAND = 0 0 0  0.5 0 0\nBAND_LABELS = G\n")
    assert len(tables.kpath_segments("BAND = 0 0 0 1 0 0 , 0 0 0 0 1 0")[0]) == 3
    assert len(tables.kpath_segments("BAND = 0 0 0 1 0 0 , 0 0 0 0 1 0", commas_split=True)[0]) == 2


def test_small_formats(spark, tmp_path):
    w = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    poscar = tables.read_poscar(spark, w("P", "c\n2.0\n1 0 0\n0 1 0\n0 0 1\nFe C\n1 1\nDirect\n0 0 0\n0.5 0.5 0.5\n")).first()
    assert poscar["lattice"][0] == 2.0 and [(a["symbol"], a["pos"]) for a in poscar["atoms"]] == [("Fe", [0.0, 0.0, 0.0]), ("C", [1.0, 1.0, 1.0])]
    log = tables.read_log(spark, w("L", "100 1 2\n200 3 4\n\n"), 2).collect()
    assert [(r["gen"], r["c2"]) for r in log] == [(100, 2.0), (200, 4.0)]
    assert tables.read_spectrum(spark, w("D", "# h\n0.1 2\n")).count() == 1
    thermal = tables.read_thermal(spark, w("T", "natom: 2\n- temperature: 0\n  free_energy: 1\n  entropy: 0\n  heat_capacity: 0\n  energy: 1\n\n- temperature: 100\n  free_energy: 0.5\n  entropy: 10\n  heat_capacity: 3\n  energy: 1.5\n")).orderBy("temperature").collect()
    assert len(thermal) == 2 and thermal[1]["energy"] == thermal[1]["free_energy"] + 100 * thermal[1]["entropy"] / 1000
    errors = tables.read_errors(spark, w("E.csv", "index,energy_MAE,force_MAE,stress_MAE,,,\n0,1,2,3,,,\n"))
    assert errors.columns == ["index", "energy_MAE", "force_MAE", "stress_MAE"] and errors.count() == 1
    assert tables.read_csv(spark, str(tmp_path / "none.csv")) is None
    assert len(tables.kpath_points(spark, "BAND = 0 0 0 1 0 0", 5).collect()) == 5


def test_reports_and_stages(spark, tmp_path):
    one = spark.sql("select 3 as b, 2.5D as a, cast(null as string) as c")
    assert {(r["key"], r["value"]) for r in metrics.report(one).collect()} == {("b", "3"), ("a", "2.5"), ("c", "")}
    assert sinks.summary_json(one).index('"a"') < sinks.summary_json(one).index('"b"')
    assert "a: 2.500" in sinks.text_report({"T": one})
    both = sinks.stacked([spark.sql("select 1 as x"), spark.sql("select 2 as y")])
    assert both.columns == ["x", "y"] and both.count() == 2
    assert signature("s", {"a": {2, 1}, "b": (1,)}) == signature("s", {"b": [1], "a": {1, 2}})
    store, made = StageStore(spark, str(tmp_path)), []
    make = lambda: made.append(1) or spark.range(3)
    assert store.stage("x", {"map": 1}, make).count() == 3 == store.stage("x", {"map": 1}, make).count()
    store.stage("x", {"map": 2}, make)
    assert len(made) == 2
    store.remove("x", {"map": 2})
    assert store.load("x", {"map": 2}) is None


def test_stored_stage_follows_its_table(spark, tmp_path):
    counts = lambda: {r["n_items"]: r["n_envs"] for r in queries.stored_stage(spark, str(tmp_path)).collect()}
    write = lambda rows, mode: spark.createDataFrame(rows, "struct_id long, env string").coalesce(1).write.mode(mode).parquet(f"{tmp_path}/struct_envs.parquet")
    write([(1, "a"), (2, "a"), (1, "b")], "overwrite")
    assert counts() == {1: 1, 2: 1} == counts()
    write([(3, "b"), (3, "c")], "append")
    assert counts() == {1: 1, 2: 2}
    write([(1, "d")], "overwrite")
    assert counts() == {1: 1}


def test_cluster_index_has_every_center(spark):
    d = "/root/testdata/sf0.001"
    centers = {r["meta"]: r["n_centers"] for r in queries.center_metas(spark, d).collect()}
    assert {r["effective_fp"]: r["count"] for r in queries.cluster_index(spark, d).groupBy("effective_fp").count().collect()} == centers and max(centers.values()) > 3
    rows = spark.createDataFrame([(f"r3.0:Fe:cn{t}:", f"raw{k % 5}", k, 0) for t, n in ((1, 40), (2, 3)) for k in range(n)], "type string, raw string, source_idx long, i int")
    got = sinks.cluster_index(Scratch(spark), rows.repartition(3)).collect()
    want = {(t, f"raw{k % 5}", k) for t, n in (("r3.0:Fe:cn1:", 40), ("r3.0:Fe:cn2:", 3)) for k in range(n)}
    assert {(r["effective_fp"], r["raw_fp"], r["source_idx"]) for r in got} == want
    for t in ("r3.0:Fe:cn1:", "r3.0:Fe:cn2:"):
        own = sorted((r["raw_fp"], r["source_idx"], r["cif_file"]) for r in got if r["effective_fp"] == t)
        assert [int(f[-9:-4]) for _, _, f in own] == list(range(1, len(own) + 1))
    assert sinks.cluster_index(Scratch(spark), rows, per_type=3).count() == 6 and sinks.cluster_index(Scratch(spark), rows, overall=5).count() == 5


def test_a_named_scratch_goes_on_where_it_ended(spark, tmp_path):
    made = []

    def count(df):
        made.append(1)
        return df

    name = f"test-{tmp_path.name}"
    first = Scratch(spark, name)
    a = first.keep(spark.range(5))
    first.drop(a)
    again = Scratch(spark, name)
    assert again.keep(spark.range(9)).count() == 5 and again.keep(spark.range(3)).count() == 3
    again.remove()
    assert Scratch(spark, name).keep(spark.range(9)).count() == 9
    Scratch(spark, name).remove()


def test_stored_selection_follows_files_and_settings(spark, tmp_path):
    from dataclasses import replace

    from covermill.plans.config import Config
    from covermill.plans.selection import stored_selection

    def frames(n):
        cell = [12.0, 0.0, 0.0, 0.0, 12.0, 0.0, 0.0, 0.0, 12.0]
        rows = []
        for k in range(n):
            atoms = [("Fe", [2.4 * i, 0.1 * k * (i % 2), 0.0], None) for i in range(2 + k % 3)] + [("C", [0.0, 2.0, 0.5 * (k % 2)], None)]
            rows.append((k, cell, [True] * 3, atoms))
        return spark.createDataFrame(rows, "frame_id long, lattice array<double>, pbc array<boolean>, atoms array<struct<symbol:string,pos:array<double>,forces:array<double>>>")

    path, root = str(tmp_path / "frames"), str(tmp_path / "stages")
    frames(6).write.parquet(path)
    stored = lambda cfg=Config(): stored_selection(spark, root, path, path, cfg)
    one = stored()
    assert one["manifest"].count() > 0 and one["universe"].select("item").distinct().count() == 6
    # all of the probe's tokens are known to the map, so nothing is probe-only
    assert one["probe"].where("is_probe_only").count() == 0
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("_SUCCESS")}
    stored()
    assert times == {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("_SUCCESS")}
    wider = stored(replace(Config(), bond_tolerance=5.0))
    assert len(list((tmp_path / "stages" / "tokens").iterdir())) == 1 and len(list((tmp_path / "stages" / "map").iterdir())) == 2
    assert wider["map"].select("type").distinct().count() <= one["map"].select("type").distinct().count()
    frames(9).write.mode("overwrite").parquet(path)
    assert stored()["universe"].select("item").distinct().count() == 9


def test_windows_of_a_stream_and_late_rows(spark, tmp_path):
    from covermill.streaming import intake

    def put(n, rows):
        spark.createDataFrame(rows, "at string, kind string").selectExpr("cast(at as timestamp) as at", "kind").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    def run():
        schema = "at timestamp, kind string"
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        counts = intake.windowed_counts(stream, "at", "kind", "1 hour", "2 hours")
        intake.start_windows(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {(r["window_start"].hour, r["kind"]): r["n"] for r in intake.latest_windows(spark, str(tmp_path / "out"), "kind").collect()}

    put(0, [("2024-01-01 01:10:00", "a"), ("2024-01-01 01:50:00", "a"), ("2024-01-01 02:00:00", "b")])
    assert run() == {(1, "a"): 2, (2, "b"): 1}
    put(1, [("2024-01-01 01:20:00", "a"), ("2024-01-01 09:00:00", "b")])
    assert run() == {(1, "a"): 3, (2, "b"): 1, (9, "b"): 1}
    # the watermark is at seven o'clock now
    put(2, [("2024-01-01 01:30:00", "a"), ("2024-01-01 09:30:00", "b")])
    assert run() == {(1, "a"): 3, (2, "b"): 1, (9, "b"): 2}
