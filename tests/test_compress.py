import numpy as np
import pytest

from covermill.operators import compress
from covermill.operators.components import components
from covermill.session import Scratch


def brute_ward(x, most):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                p, q = x[groups[a]], x[groups[b]]
                h = np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(p.mean(0) - q.mean(0))
                if best is None or h < best[0]:
                    best = (h, a, b)
        if best[0] > most:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(5))
def test_ward_is_the_agglomerative_one(seed):
    x = np.random.default_rng(seed).normal(size=(20, 3))
    labels = compress.ward_labels(x, 1.5)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == brute_ward(x, 1.5)


def test_fit_and_frozen(spark):
    dim = spark.createDataFrame([("a", "m", [1.0, 90.0, 0.0]), ("b", "m", [1.01, 90.0, 0.0]), ("c", "m", [3.0, 90.0, 0.0]), ("d", None, None)], "raw string, meta string, feature array<double>")
    types = {r["raw"]: r["type"] for r in compress.fit_types(Scratch(spark), dim).collect()}
    assert types["a"] == types["b"] != types["c"] and types["d"] == "d:sim00001"
    frozen = spark.createDataFrame([("a", "A")], "raw string, type string")
    got = {r["raw"]: (r["type"], r["is_new"]) for r in compress.frozen_types(dim.select("raw", "meta"), frozen).collect()}
    assert got["a"] == ("A", False) and got["b"][0].startswith("m:frozen_new:") and len(got["b"][0].rpartition(":")[2]) == 8 and got["d"][0].startswith("d:frozen_new:")


def test_types_of_a_group_are_wards_of_the_whole(spark):
    """A group is taken apart into components of near points; the clusters are those of the group as one."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.05, size=(25, 3)) * [1, 1, 40] + [0, 0, 90] for c in (1.0, 1.15, 2.0)]).astype(np.float32)
    dim = spark.createDataFrame([(f"t{i:03d}", "m", [float(v) for v in r]) for i, r in enumerate(x)], "raw string, meta string, feature array<float>")
    got = {}
    for r in compress.fit_types(Scratch(spark), dim).collect():
        got.setdefault(r["type"], set()).add(int(r["raw"][1:]))
    scaled = x.astype(np.float64) / np.array([0.05, 5.0, 5.0]) / np.sqrt(3)
    assert {frozenset(v) for v in got.values()} == brute_ward(scaled, 1.0) and len(got) > 2


def test_names_are_clustered_below_a_similarity_of_one(spark):
    raws = ["r3:Fe:cn8:aab", "r3:Fe:cn8:aac", "r3:C:cn1:zz", "r3:Fe:cn8:aad", "xyz"]
    dim = spark.createDataFrame([(r, "m", None) for r in raws], "raw string, meta string, feature array<double>")
    types = lambda t: {r["raw"]: r["type"] for r in compress.fit_types(Scratch(spark), dim, topology=t).collect()}
    assert len(set(types(1.0).values())) == 5
    got = types(0.85)
    links = [(a, b) for a in raws for b in raws if a < b and compress.topology_ratio(a, b) >= 0.85]
    assert links and all(got[a] == got[b] for a, b in links) and len(set(got.values())) == 5 - 2


def test_topology_links_are_all_of_them(spark):
    rng = np.random.default_rng(5)
    names = sorted({":".join(rng.choice(["Fe", "C", "cn1", "cn2", "r2.7", "aa", "ab", "#"], size=rng.integers(2, 6))) for _ in range(150)})
    rows = [(i % 2 if i % 9 else None, n) for i, n in enumerate(names)]
    got = {(r["a"], r["b"]) for r in compress.topology_links(Scratch(spark), spark.createDataFrame(rows, "`group` int, name string"), 0.8).collect()}
    want = {(a, b) for g, a in rows for h, b in rows if a < b and g == h and compress.topology_ratio(a, b) >= 0.8}
    assert got == want and len(want) > 20
    assert compress.topology_links(Scratch(spark), spark.createDataFrame([], "`group` int, name string"), 0.8).count() == 0


def test_topology():
    assert compress.topology_ratio("a1", "a1") == 1.0
    assert compress.topology_ratio("", "") == 1.0
    assert compress.topology_ratio("a1", "b2") < 0.5


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1)], "a long, b long")
    assert {(r["item"], r["root"]) for r in components(Scratch(spark), links).collect()} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (7, 7)}
    assert components(Scratch(spark), links.limit(0)).count() == 0


def test_distance_links(spark):
    rng = np.random.default_rng(1)
    pts = [(0, i, rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(pts, "`group` int, id long, x array<double>")
    for block in (4, 2000):
        for threshold in (0.3, 0.9, 2.0):
            rows = [(r["a"], r["b"]) for r in compress.distance_links(Scratch(spark), df, threshold, block=block).collect()]
            want = {(a, b) for _, a, x in pts for _, b, y in pts if a < b and np.linalg.norm(np.array(x) - np.array(y)) <= threshold}
            assert len(rows) == len(set(rows)) and set(rows) == want
    few = compress.distance_links(Scratch(spark), df, 2.0, forest=True, block=4)
    both = [{(r["item"], r["root"]) for r in components(Scratch(spark), d.select("a", "b")).collect()} for d in (few, compress.distance_links(Scratch(spark), df, 2.0))]
    assert both[0] == both[1] and few.count() < len(want)


def test_distance_components_take_copies_short_and_missing_points(spark):
    rows = [(0, 1, [0.0, 0.0]), (0, 2, [0.0, 0.0]), (0, 3, [0.5, 0.0]), (0, 4, [3.0, 0.0]), (1, 5, [0.0, 0.0]), (0, 6, None), (0, 7, None), (0, 8, [])]
    df = spark.createDataFrame(rows, "`group` int, id long, x array<double>")
    got = {r["id"]: r["cluster"] for r in compress.distance_components(Scratch(spark), df, 0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert compress.distance_components(Scratch(spark), df.limit(0), 0.6).count() == 0
