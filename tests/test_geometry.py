import math

from covermill.operators import geometry, series
from covermill.plans import selection
from covermill.session import Scratch
from covermill.sources import sinks

FRAME = "frame_id long, lattice array<double>, pbc array<boolean>, atoms array<struct<symbol:string,pos:array<double>,forces:array<double>>>, n_atoms int, step long, energy double, stress array<double>"
CUBE = [10.0, 0, 0, 0, 10.0, 0, 0, 0, 10.0]


def frames(spark, *atom_lists, lattice=CUBE, pbc=(True, True, True)):
    rows = [(i, [float(v) for v in lattice], list(pbc), [(s, [float(v) for v in p], [0.0, 0.0, 1.0]) for s, p in atoms], len(atoms), i, -1.0, None) for i, atoms in enumerate(atom_lists)]
    return spark.createDataFrame(rows, FRAME)


def test_nearest_image_and_strict_limit(spark):
    limit = (1.32 + 1.32) * 0.8
    f = frames(spark, [("Fe", (0.5, 0, 0)), ("fe", (9.5, 0, 0))], [("Fe", (0, 0, 0)), ("Fe", (limit, 0, 0))], [("Fe", (0, 0, 0))], [])
    near = geometry.neighbours(f, 3.0).where("frame_id = 0 and i = 0").collect()
    assert len(near) == 1 and abs(near[0]["distance"] - 1.0) < 1e-9 and abs(near[0]["dx"] + 1.0) < 1e-9
    got = {r["frame_id"]: r["is_physical"] for r in geometry.physical(f.unionByName(f)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}
    open_cell = frames(spark, [("Fe", (0.5, 0, 0)), ("Fe", (9.5, 0, 0))], pbc=(False, False, False))
    assert geometry.neighbours(open_cell, 3.0).count() == 0


def test_angles_and_features(spark):
    f = frames(spark, [("Fe", (5, 5, 5)), ("C", (6, 5, 5))], [("Fe", (5, 5, 5)), ("C", (6, 5, 5)), ("C", (5, 6, 5))])
    near = geometry.environments(f, 1.2)
    got = {(r["frame_id"], r["i"]): r["feature"] for r in geometry.features(near).collect()}
    assert all(abs(a - b) < 1e-9 for a, b in zip(got[0, 0], [1.0, 90.0, 0.0]))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got[1, 0], [1.0, 1.0, 90.0, 0.0]))
    assert {r["meta"] for r in geometry.meta_keys(near, 1.2).where("frame_id = 1 and i = 0").collect()} == {"r1.2:Fe:cn2:CC"}
    assert geometry.environments(f, 20.0).count() == 0


def test_tokens_do_not_change_with_numbers_shift_or_axes(spark):
    atoms = [("Fe", (1, 1, 1)), ("C", (2.1, 1, 1)), ("Fe", (1, 2.4, 1)), ("C", (2.0, 2.2, 1.3))]
    moved = [(s, ((y + 3) % 10, (z + 9.5) % 10, (x + 2) % 10)) for s, (x, y, z) in reversed(atoms)]
    f = frames(spark, atoms, moved)
    rows = geometry.raw_tokens(geometry.environments(f, 2.0), 2.0).collect()
    a, b = (sorted(r["raw"] for r in rows if r["frame_id"] == k) for k in (0, 1))
    assert a == b and len(a) == 4


def test_series(spark):
    pts = spark.createDataFrame([(1, t, float(9.0 + t) % 10, 10.0) for t in range(4)], "p int, t int, x double, box double")
    msd = {r["t"]: r["msd"] for r in series.mean_square_displacement(pts, [], "p", "t", ["x"], {"x": "box"}).collect()}
    assert msd == {0: 0.0, 1: 1.0, 2: 4.0, 3: 9.0}
    line = spark.createDataFrame([(1, float(x), 2.0 * x) for x in (0, 2, 4)], "g int, x double, y double")
    other = spark.createDataFrame([(1, float(x), 5.0 - x) for x in range(-1, 6)], "g int, x double, y double")
    row = series.correlation(other, line, ["g"]).first()
    assert row["n"] == 5 and math.isclose(row["pearson"], -1.0)
    assert series.correlation(other.limit(0), line, ["g"]).count() == 0
    f = frames(spark, [("Fe", (0, 0, 0)), ("Fe", (2, 0, 0))])
    rdf = series.radial_distribution(f, 4.0, 0.5).collect()
    assert [(r["kind"], r["bin"], r["n_pairs"]) for r in rdf] == [("Fe-Fe", 4, 1)]
    mae = series.mean_absolute_errors(f, f, "frame_id").first()
    assert mae["energy_mae"] == 0 and mae["force_mae"] == 0 and mae["stress_mae"] is None


def test_universe_has_all_cutoffs_and_physical_frames_only(spark):
    atoms = lambda *xs: [("C" if k % 2 else "Fe", (x, 0, 0)) for k, x in enumerate(xs)]
    rows = frames(spark, atoms(0, 2.0), atoms(0, 2.9), atoms(0, 1.0, 3.0), atoms(0, 2.0, 4.85))
    inc = selection.universe(Scratch(spark), rows).collect()
    at = lambda k: {r["env"].partition(":sim")[0] for r in inc if r["item"] == k}
    assert at(0) == {"r2.7:fe:cn1:c", "r2.7:c:cn1:fe", "r3.0:fe:cn1:c", "r3.0:c:cn1:fe"}
    assert at(1) == {"r3.0:fe:cn1:c", "r3.0:c:cn1:fe"} and at(2) == set()
    assert at(3) == {"r2.7:fe:cn1:c", "r2.7:c:cn1:fe", "r3.0:fe:cn1:c", "r3.0:c:cn2:fefe"}


def test_clusters_as_cif(spark):
    cell = [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0]
    rows = [(1, cell, [True] * 3, [("Fe", [9.9, 0.0, 0.0], None), ("C", [1.0, 0.0, 0.0], None), ("C", [5.0, 5.0, 5.0], None)])]
    frames = spark.createDataFrame(rows, "frame_id long, lattice array<double>, pbc array<boolean>, atoms array<struct<symbol:string,pos:array<double>,forces:array<double>>>")
    got = {r["i"]: r["cif"] for r in sinks.cif_text(geometry.cluster_atoms(frames, 3.0)).collect()}
    assert set(got) == {0, 1}
    lines = got[0].strip().split("\n")
    assert lines[0] == "data_1_0" and "_cell_length_a 14.000000" in lines
    atoms = [line.split() for line in lines if line[:2] in ("Fe", "C1", "C2")]
    # across the cell's edge, in the middle of the cube
    assert [a[1] for a in atoms] == ["Fe", "C"] and abs((float(atoms[1][2]) - float(atoms[0][2])) * 14 - 1.1) < 1e-6
    assert abs((float(atoms[1][2]) + float(atoms[0][2])) / 2 - 0.5) < 1e-6


def test_radii_of_heavy_atoms(spark):
    cell = [20.0, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 20.0]
    pair = lambda s, d: [(s, [0.0, 0.0, 0.0], None), (s, [d, 0.0, 0.0], None)]
    rows = [(1, cell, None, pair("cs", 3.8)), (2, cell, None, pair("Cs", 4.0)), (3, cell, None, pair("Xx", 0.33)), (4, cell, None, pair("Xx", 0.3))]
    frames = spark.createDataFrame(rows, "frame_id long, lattice array<double>, pbc array<boolean>, atoms array<struct<symbol:string,pos:array<double>,forces:array<double>>>")
    assert {r["frame_id"]: r["is_physical"] for r in geometry.physical(frames).collect()} == {1: False, 2: True, 3: True, 4: False}
