import hashlib
import random

import pytest
from pyspark.sql import functions as F

from covermill.functions import scalar
from covermill.operators import cover, incidence, sampling, setsim
from covermill.plans import queries, selection
from covermill.session import Scratch


def greedy(sets):
    done, out = set(), []
    while True:
        best = min(((-len(s - done), k) for k, s in sets.items()), default=(0, None))
        if best[0] == 0:
            return out
        out.append((best[1], -best[0]))
        done |= sets[best[1]]


def frame(spark, sets):
    rows = [(k, e) for k, s in sets.items() for e in s]
    return spark.createDataFrame(rows, "item long, env string")


def random_sets(seed, n=25, m=30):
    rng = random.Random(seed)
    return {k: {f"e{rng.randrange(m)}" for _ in range(rng.randrange(1, 7))} for k in range(n)}


@pytest.mark.parametrize("finish", [0, 15, 40, 10_000])
def test_rounds_give_the_greedy_sequence(spark, finish):
    sets = random_sets(finish + 1)
    rows = cover.greedy_cover(Scratch(spark), frame(spark, sets), finish=finish).orderBy("rank").collect()
    want = sorted(greedy(sets), key=lambda p: (-p[1], p[0]))
    assert [(r["item"], r["new_gain"]) for r in rows] == want == greedy(sets)
    assert rows[-1]["uncovered"] == 0 and rows[-1]["coverage_pct"] == 100


def test_ties_budget_and_stop(spark):
    inc = frame(spark, {2: {"a", "b"}, 1: {"a", "b"}, 3: {"c"}, 4: {"d"}})
    run = lambda **k: [r["item"] for r in cover.greedy_cover(Scratch(spark), inc, **k).orderBy("rank").collect()]
    assert run() == [1, 3, 4]
    assert run(budget=1) == [1]
    assert run(stop_pct=75.0) == [1, 3]
    assert run(stop_pct=0.0) == []
    assert cover.greedy_cover(Scratch(spark), inc.limit(0)).count() == 0


def sequential_sweep(sets, order, partners=None):
    left = list(order)
    for k in order:
        others = [o for o in left if o != k]
        covered = set().union(*(sets[o] for o in others)) if others else set()
        near = partners is None or any(o in partners.get(k, ()) for o in others)
        if sets[k] <= covered and near:
            left = others
    return set(left)


@pytest.mark.parametrize("seed, finish", [(1, 0), (2, 40), (3, 10_000)])
def test_sweep_is_the_sequential_one(spark, seed, finish):
    sets = random_sets(seed, 18, 14)
    rng = random.Random(seed)
    order = list(sets)
    rng.shuffle(order)
    places = spark.createDataFrame([(k, i) for i, k in enumerate(order)], "item long, place int")
    got = {r["item"] for r in cover.sweep(Scratch(spark), frame(spark, sets), places, finish=finish).collect()}
    assert got == sequential_sweep(sets, order)
    links = [(a, b) for a in sets for b in sets if a < b and rng.random() < 0.2]
    partners = {k: {b for a, b in links if a == k} | {a for a, b in links if b == k} for k in sets}
    got = {r["item"] for r in cover.sweep(Scratch(spark), frame(spark, sets), places, spark.createDataFrame(links, "a long, b long"), finish).collect()}
    assert got == sequential_sweep(sets, order, partners)


def test_a_sweep_of_all_suppliers(spark, tmp_path):
    # a supplier of 30 and more is redundant as well, and a dense chain takes few rounds
    rng = random.Random(3)
    spark.createDataFrame([(p, f"B{p % 6}", p % 4) for p in range(48)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, rng.randrange(48)) for k in range(60) for _ in range(5)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = {k: {(p % 6, p % 4) for s, p in lines if s == k} for k in range(60)}
    run = lambda name: {r["suppkey"] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    got = run("prune_dense_sweep")
    assert got == sequential_sweep(sets, sorted(sets)) and max(got) >= 30
    assert run("prune_dense_all") == sequential_sweep(sets, sorted(sets, reverse=True))


@pytest.mark.parametrize("name, sign", [("prune_dense_all", -1), ("prune_dense_sweep", 1)])
def test_only_rows_of_last_suppliers_are_stored(spark, tmp_path, monkeypatch, name, sign):
    # of some 3,000 pairs of a supplier and an env all were stored; keys without a partner, two envs of a key, blanks and case
    rng = random.Random(7)
    parts = [(p, f"B{p % 6}" if p % 5 else f"b {p % 6}", p % 4) for p in range(48)] + [(3, "B9", 9), (None, "B8", 8)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(rng.randrange(400), rng.randrange(50)) for _ in range(4000)] + [(None, 1), (401, None), (402, 49)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    envs = {k: {(b.lower().replace(" ", ""), s) for p, b, s in parts if p == k} for k in range(50)}
    sets = {k: set().union(*(envs[p] for s, p in lines if s == k)) for k in {s for s, p in lines if envs.get(p)} - {None}}
    keep, sizes = Scratch.keep, []

    def counted(self, df, by=()):
        kept = keep(self, df, by)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    got = {r["suppkey"] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    assert got == sequential_sweep(sets, sorted(sets, key=lambda k: sign * k))
    assert sum(map(len, sets.values())) > 2500 and max(sizes) < 500


def test_a_block_spares_rounds(spark):
    sets = {k: {f"e{k % 7}", f"e{(k + 1) % 7}", f"e{(k + 3) % 7}"} for k in range(60)}
    scratch = Scratch(spark)
    inc = scratch.keep(frame(spark, sets))
    got = {r["item"] for r in cover.sweep(scratch, inc, inc.selectExpr("item", "item as place").distinct(), finish=120).collect()}
    assert got == sequential_sweep(sets, sorted(sets)) and scratch.count < 15


@pytest.mark.parametrize("sign", [1, -1])
def test_a_dense_sweep_takes_few_rounds(spark, sign):
    # items that are nowhere the last go at once: by blocks of 60 rows this took 40 rounds
    rng = random.Random(11)
    sets = {k: {f"e{e}" for e in rng.sample(range(24), 5)} for k in range(400)}
    scratch = Scratch(spark)
    inc = scratch.keep(frame(spark, sets))
    got = {r["item"] for r in cover.sweep(scratch, inc, inc.selectExpr("item", f"{sign} * item as place").distinct(), finish=60).collect()}
    assert got == sequential_sweep(sets, sorted(sets, key=lambda k: sign * k)) and scratch.count < 20


def test_bare_items_and_unknown_ones_in_a_sweep(spark):
    # 7 has no envs and goes, 8 is not in the order and holds nothing
    inc = frame(spark, {1: {"a", "b"}, 2: {"b", "c"}, 3: {"c", "a"}, 8: {"a", "b", "c"}})
    places = spark.createDataFrame([(7, "w"), (1, "x"), (2, "y"), (3, "z")], "item long, place string")
    for finish in (0, 10_000):
        assert [tuple(r) for r in cover.sweep(Scratch(spark), inc, places, finish=finish).orderBy("item").collect()] == [(2, "y"), (3, "z")]


def test_band_drops_a_pair_and_copies_collapse(spark):
    inc = frame(spark, {1: {f"e{i}" for i in range(7)}, 2: {f"e{i}" for i in range(10)}, 3: {f"e{i}" for i in range(10)}})
    sets = setsim.token_sets(Scratch(spark), inc)
    assert {(r["a"], r["b"]) for r in setsim.overlap_links(sets, 0.7, 0.25).collect()} == {(2, 3)}
    assert {(r["a"], r["b"]) for r in setsim.overlap_links(sets, 0.7, None).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r["item"], r["first"]) for r in setsim.exact_copies(inc).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_the_target_counts_what_no_item_has(spark):
    """85 % of ten envs is nine picks, though the items have eight of them only."""
    inc = frame(spark, {k: {f"e{k}"} for k in range(8)})
    rows = cover.greedy_cover(Scratch(spark), inc, stop_pct=75.0, target=10).orderBy("rank").collect()
    assert len(rows) == 8 and rows[-1]["uncovered"] == 2 and rows[-1]["coverage_pct"] == 80
    assert cover.greedy_cover(Scratch(spark), inc, stop_pct=75.0).count() == 6


def test_similar_items_with_copies_go_as_one_by_one(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sets = {k: {f"e{i}" for i in range(12)} - {f"e{rng.randrange(12)}"} for k in range(12)}
        sets |= {20 + k: set(sets[k % 4]) for k in range(8)} | {40: {"q"}, 41: {"q"}}
        order = list(sets)
        rng.shuffle(order)
        by_size = sorted(order, key=lambda k: (-len(sets[k]), order.index(k)))
        near = {a: {b for b in sets if a != b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])} for a in sets}
        places = spark.createDataFrame([(k, i) for i, k in enumerate(order)], "item long, place int")
        got = {r["item"] for r in cover.without_similar(Scratch(spark), frame(spark, sets), places).collect()}
        assert got == sequential_sweep(sets, by_size, near)
    assert cover.without_similar(Scratch(spark), frame(spark, sets), places, 1.5).count() == len(sets)


def test_links_of_items_count_copies_without_pairs(spark):
    base = [f"e{i}" for i in range(20)]
    inc = Scratch(spark).keep(frame(spark, {1: set(base), 2: set(base), 3: set(base[1:]), 4: set(base[1:]), 5: set(base[1:]), 9: {"q"}}))
    copies, links = setsim.class_links(Scratch(spark), inc, 0.85, 0.25)
    rows = {r["item"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in setsim.links_of_items(copies, links).collect()}
    assert rows == {1: (1, 1, 3), 2: (1, 1, 3), 3: (3, 2, 2), 4: (3, 2, 2), 5: (3, 2, 2), 9: (9, 0, 0)} and links.count() == 1


def test_systematic_samples(spark):
    names = spark.createDataFrame([(f"n{i:02d}", i < 8) for i in range(20)] + [("n00", False), (None, True)], "name string, priority boolean")
    run = lambda most: sorted(r["name"] for r in sampling.systematic(Scratch(spark), names, most).collect())
    assert run(0) == run(20) == run(50) == [f"n{i:02d}" for i in range(20)]
    assert run(5) == ["n00", "n02", "n04", "n06"]
    assert run(12) == [f"n{i:02d}" for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 14, 17)]


def test_names_cutoffs_and_centers(spark):
    long = "a b" * 60
    df = spark.createDataFrame([("probe_only:r2.7:19ab", long), ("r3.0:Fe:cn8:x", "x/y"), ("r3:c:CN2:y", ""), ("none", None), (None, "z")], "key string, name string")
    rows = df.select(scalar.rcut_of(F.col("key")), scalar.center_of(F.col("key")), scalar.safe_name(F.col("name")), scalar.safe_name(F.col("name"), 20)).collect()
    clean = "a_b" * 60
    short = lambda n: clean[: n - 11] + "_" + hashlib.sha1(clean.encode()).hexdigest()[:10]
    assert [tuple(r) for r in rows] == [(2.7, "?", short(120), short(20)), (3.0, "Fe", "x_y", "x_y"), (3.0, "c", "", ""), (3.0, "?", None, None), (3.0, None, "z", "z")]
    assert len(rows[0][2]) == 120


def test_chain_keeps_the_largest(spark):
    base = [f"e{i}" for i in range(20)]
    inc = frame(spark, {1: set(base), 2: set(base[1:] + ["x", "y"]), 3: set(base[2:] + ["x", "y", "z"]), 9: {"q"}})
    rows = {r["item"]: (r["root"], r["is_kept"]) for r in setsim.representatives(Scratch(spark), inc, 0.85, 0.25).collect()}
    assert rows[1][0] == rows[2][0] == rows[3][0] == 1 and rows[9] == (9, True)
    assert [k for k in (1, 2, 3) if rows[k][1]] == [2]


def test_incidence_takes_dirt_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, " A​b ", "x", 1), (1, "ab", "x", 2), (None, "c", "x", 3), (2, None, "x", 4), (3, "  ", "x", 5)], "id long, name string, item string, env int")
    assert [tuple(r) for r in incidence.incidence(rows, "id", "name").collect()] == [(1, "ab")]


def test_pipelines(spark):
    sets = random_sets(5, 30, 60)
    inc = Scratch(spark).keep(frame(spark, sets))
    rows = selection.initial_selection(Scratch(spark), inc, finish=0).orderBy("rank").collect()
    assert rows and rows[-1]["covered"] == len(set().union(*(sets[r["item"]] for r in rows)))
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    covered = inc.select("env").distinct()
    assert selection.gap_supplement(Scratch(spark), inc, covered).count() == 0
    joint = selection.joint_cover(Scratch(spark), inc.where("item < 15"), inc.where("item >= 10")).collect()
    got = set().union(*(sets[r["source_idx"]] for r in joint))
    assert got == set().union(*sets.values())
