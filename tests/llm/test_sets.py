import random
from collections import Counter

import pytest

from covermill.llm import groups, history, neardup, pairs, records, subset, terms
from covermill.session import Scratch

T85, T80 = records.Threshold(17, 20), records.Threshold(4, 5)
ENVS = "struct_id long, center_atom_index int, env string, id string"


def families(seed, n=60, m=400):
    """Records of center atoms, many of them small edits of another."""
    rng = random.Random(seed)
    out = {}
    for k in range(1, n):
        if k > 5 and rng.random() < 0.7:
            base = list(out[rng.randrange(1, k)])
            for _ in range(rng.randrange(0, 4)):
                base[rng.randrange(len(base))] = f"e{rng.randrange(m)}"
        else:
            base = [f"e{min(rng.randrange(m), rng.randrange(m))}" for _ in range(rng.randrange(1, 30))]
        out[k] = base
    return out


def table(spark, recs):
    rows = [(k, i, e if (k + i) % 7 else f" {e.upper()}​", "x") for k, v in recs.items() for i, e in enumerate(v)]
    rows += rows[:5] + [(None, 0, "e1", "x"), (1, 0, None, "x"), (1, None, "  ", "x")]
    return spark.createDataFrame(rows, ENVS)


def overlap(a, b):
    return sum((a & b).values()), sum((a | b).values())


def closed(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def found(spark, recs, counted=False):
    scratch = Scratch(spark)
    return scratch, records.classes(scratch, records.record_sets(table(spark, recs), "struct_id", "env", "center_atom_index" if counted else None))


def test_terms(spark):
    recs = families(1)
    got = {r["value"]: (r["occurrences"], r["records"]) for r in terms.term_frequencies(table(spark, recs), "struct_id", "env", "center_atom_index").collect()}
    assert got == {e: (sum(v.count(e) for v in recs.values()), sum(e in v for v in recs.values())) for e in set(sum(recs.values(), []))}
    marks = {r["value"]: r["freq_mark"] for r in terms.marked_terms(table(spark, recs), "struct_id", "env", "center_atom_index", 1, 0.2).collect()}
    assert marks == {e: "rare" if n == 1 else "common" if n > 0.2 * len(recs) else None for e, (_, n) in got.items()}
    assert terms.term_frequencies(table(spark, recs).limit(0), "struct_id", "env", "center_atom_index").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed):
    recs = families(seed)
    scratch, both = found(spark, recs)
    got = [(r["a"], r["b"]) for r in pairs.similar_pairs(scratch, both, T85).collect()]
    sets = {k: Counter(set(v)) for k, v in recs.items()}
    want = {(a, b) for a in sets for b in sets if a < b and (o := overlap(sets[a], sets[b])) and 20 * o[0] >= 17 * o[1]}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_near_duplicates(spark):
    recs = families(3)
    scratch, both = found(spark, recs, True)
    got = {r["id"]: r["group_id"] for r in neardup.similar_groups(scratch, both, T80).collect()}
    sets = {k: Counter(v) for k, v in recs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and (o := overlap(sets[a], sets[b])) and 5 * o[0] >= 4 * o[1]]
    roots = closed(sets, links)
    size = Counter(roots.values())
    assert got == {k: r for k, r in roots.items() if size[r] > 1}
    # buckets of three records at most, so that paths grow and pivots link, give the same groups
    again = {r["id"]: r["group_id"] for r in neardup.similar_groups(scratch, both, T80, 1e-12, 3).collect()}
    assert again == got


def test_near_duplicates_of_frequent_tokens_only(spark):
    """All pairs share only tokens that most records have: recall on the links is at least 0.9, groups are never wrong."""
    rng = random.Random(11)
    recs = {}
    for k in range(1, 400):
        recs[k] = rng.sample([f"e{i}" for i in range(60)], 30) if k % 2 else list(recs[k - 1])
        if not k % 2:
            recs[k][rng.randrange(30)] = f"x{k}"
    scratch, both = found(spark, recs, True)
    links = {(r["a"], r["b"]) for r in neardup.similar_links(scratch, both.sets, T80, 1e-6, 16).collect()}
    want = {(k - 1, k) for k in range(2, 400, 2)}
    assert links <= {p for p in links if 5 * overlap(Counter(recs[p[0]]), Counter(recs[p[1]]))[0] >= 4 * overlap(Counter(recs[p[0]]), Counter(recs[p[1]]))[1]}
    assert len(links & want) >= 0.9 * len(want)


def test_a_family_of_near_copies_is_linked_by_pivots(spark):
    """Every pair of the family is similar; its bucket closes by one link a record instead of all pairs."""
    recs = {k: [f"e{i}" for i in range(40)] + [f"x{k}"] for k in range(1, 300)}
    scratch, both = found(spark, recs, True)
    links = neardup.similar_links(scratch, both.sets, T80, 1e-6, 20)
    assert links.distinct().count() < 300 * 40
    groups_of = {r["id"]: r["group_id"] for r in neardup.similar_groups(scratch, both, T80, 1e-6, 20).collect()}
    assert groups_of == {k: 1 for k in recs}


def repeats(sets, batch):
    accepted, out = {}, set()
    for b in sorted(set(batch.values())):
        now = [k for k in sets if batch[k] == b]
        bad = {k for k in now if any((o := overlap(sets[k], s)) and 20 * o[0] >= 17 * o[1] for s in accepted.values())}
        out |= bad
        accepted |= {k: sets[k] for k in now if k not in bad}
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_history_batch_by_batch(spark, tmp_path, seed):
    recs = families(seed)
    rng = random.Random(seed)
    batch = {k: rng.randrange(4) for k in recs}
    sets = {k: Counter(set(v)) for k, v in recs.items()}
    want = repeats(sets, batch)
    scratch = Scratch(spark)
    batches = spark.createDataFrame(list(batch.items()), "id long, batch int")
    both = records.classes(scratch, records.record_sets(table(spark, recs), "struct_id", "env").join(batches, "id"), ("batch",))
    got = [r["id"] for r in history.replay(scratch, both, history.SegmentIndex(spark, str(tmp_path / "a"), T85)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    # the sets of each batch are made when it comes, from its rows alone, and another index object takes it
    seen = set()
    for b in range(4):
        index = history.SegmentIndex(spark, str(tmp_path / "b"), T85)
        own = scratch.keep(records.record_sets(table(spark, {k: v for k, v in recs.items() if batch[k] == b}), "struct_id", "env"))
        bad = scratch.keep(index.check(scratch, own))
        seen |= {r["id"] for r in bad.collect()}
        index.accept(own.join(bad, "id", "left_anti"))
    assert seen == want


def test_an_index_is_read_by_another_session(spark, tmp_path):
    recs = {1: {f"e{i}" for i in range(20)}, 2: {f"e{i}" for i in range(1, 20)}, 3: {f"f{i}" for i in range(20)}, 4: {f"f{i}" for i in range(1, 20)}}
    scratch = Scratch(spark)
    sets = scratch.keep(records.record_sets(table(spark, recs), "struct_id", "env"))
    one = lambda k: sets.where(f"id = {k}")
    ids = lambda df: {r["id"] for r in df.collect()}
    index = lambda n=None: history.SegmentIndex(spark, str(tmp_path / "index"), T85, n)
    assert ids(index(3).check(scratch, one(2))) == set()
    index().accept(one(1))
    assert index().buckets == 3 and ids(index().check(scratch, one(2))) == {2}
    index().accept(one(3))
    assert ids(index().check(scratch, sets)) == {1, 2, 3, 4}
    # a batch whose marker was not written does not count, and its next try replaces it
    (tmp_path / "index" / "buckets=3" / "done" / "batch=1").rmdir()
    assert ids(index().check(scratch, sets)) == {1, 2}
    assert ids(index().check(scratch, one(3), 1)) == set()
    index().accept(one(3), 1)
    index().accept(one(3), 1)
    assert index().batches() == [0, 1] and ids(index().check(scratch, sets)) == {1, 2, 3, 4} and ids(index().check(scratch, sets, 1)) == {1, 2}
    assert spark.read.parquet(str(tmp_path / "index" / "buckets=3" / "sets" / "batch=1")).count() == 1
    plan = index().check(scratch, one(2))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_segments_of_long_records_and_hot_keys(spark, tmp_path, monkeypatch):
    """Records of a thousand values: segments are few, probes are linear, and edits anywhere are found."""
    rng = random.Random(3)
    recs = {1: [f"a{i}" for i in range(1500)], 2: [f"b{i}" for i in range(1000)]}
    gone, more = set(rng.sample(range(1500), 100)), [f"c{i}" for i in range(120)]
    recs[11] = [v for i, v in enumerate(recs[1]) if i not in gone] + more
    recs[12] = recs[2][:920] + [f"d{i}" for i in range(300)]
    scratch = Scratch(spark)
    sets = scratch.keep(records.record_sets(table(spark, recs), "struct_id", "env"))
    index = history.SegmentIndex(spark, str(tmp_path / "long"), T85)
    index.accept(sets.where("id < 10"))
    new = sets.where("id > 10")
    assert [r["id"] for r in index.check(scratch, new).collect()] == [11]
    assert history.segment_rows(sets, T85).count() < 0.3 * 5000 and history.probe_rows(sets, T85).count() < 3 * 5000
    # a family under one segment: most of it in one batch, so the key is hot
    family = {k: [f"e{i}" for i in range(30)] + [f"x{k}_{i}" for i in range(3)] for k in range(1, 1300)}
    family |= {2000 + k: [f"e{i}" for i in range(30)] + [f"y{k}_{i}" for i in range(2 if k % 2 else 9)] for k in range(20)}
    rows = scratch.keep(records.record_sets(table(spark, family), "struct_id", "env"))
    large = history.SegmentIndex(spark, str(tmp_path / "hot"), T85)
    large.accept(rows.where("id < 2000"))
    got = {r["id"] for r in large.check(scratch, rows.where("id >= 2000")).collect()}
    sizes = {k: Counter(set(v)) for k, v in family.items()}
    assert got == {k for k in family if k >= 2000 and any(20 * overlap(sizes[k], sizes[j])[0] >= 17 * overlap(sizes[k], sizes[j])[1] for j in range(1, 1300))}


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_random_links(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = [(rng.randrange(n), rng.randrange(n), 0.9) for _ in range(40 + 20 * seed)]
    _check_groups(spark, rows)


def test_groups_of_chains_rings_stars_and_cores(spark):
    chain = [(100 + i, 101 + i, 1.0) for i in range(37)]
    ring = [(200 + i, 200 + (i + 1) % 11, 1.0) for i in range(11)]
    star = [(300, 301 + i, 1.0) for i in range(30)]
    core = [(400 + i, 400 + j, 1.0) for i in range(6) for j in range(i)] + [(405, 200, 1.0)]
    dirt = [(None, 5, 1.0), (6, None, 1.0), (7, 8, None), (8, 9, float("nan")), (9, 10, 0.8), (11, 11, 1.0), (101, 100, 1.0)]
    _check_groups(spark, chain + ring + star + core + dirt)
    assert groups.match_groups(Scratch(spark), spark.createDataFrame([], "l long, r long, s double"), "l", "r", "s", 0.85).count() == 0


def _check_groups(spark, rows):
    ids = {i for a, b, _ in rows for i in (a, b) if i is not None}
    want = closed(ids, [(a, b) for a, b, s in rows if a is not None and b is not None and s is not None and s >= 0.85])
    # the core by rounds, and by one task
    for core in (0, groups.CORE):
        got = [(r["id"], r["group_id"]) for r in groups.match_groups(Scratch(spark), spark.createDataFrame(rows, "l long, r long, s double"), "l", "r", "s", 0.85, core).collect()]
        assert len(got) == len(ids) and dict(got) == want


def test_varied_subset(spark):
    rng = random.Random(1)
    rows = [(i, "large", [rng.randrange(6) for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, f"s{i % 9}", [100 + 5 * i + k for k in range(5)]) for i in range(30)]
    rows = [(i, s, sorted(set(t))) for i, s, t in rows] + [(5000, None, [7]), (5001, "e", [])]
    df = spark.createDataFrame(rows, "id long, system string, tokens array<long>")
    got = subset.varied_subset(Scratch(spark), df, 20, part=100).collect()
    assert len({r["id"] for r in got}) == 20 and sum(r["system"] == "large" for r in got) <= 2
    assert subset.varied_subset(Scratch(spark), df.limit(3), 20).count() == 3
    assert subset.varied_subset(Scratch(spark), df.limit(0), 20).count() == 0


def dispersion(rows):
    sets = [(set(r["tokens"]), r["system"]) for r in rows]
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    return sum(1 - len(a[0] & b[0]) / len(a[0] | b[0]) + subset.SYSTEM_WEIGHT * (a[1] != b[1]) for a, b in pairs) / len(pairs)


def test_varied_subset_against_chance_and_one_search_over_all(spark):
    """By core-sets of a fifth of the records each: far better than chance, within 3 % of a local search over all."""
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        family = min(rng.randrange(40), rng.randrange(40))
        rows.append((i, f"s{family // 4}", sorted({100 * family + min(rng.randrange(60), rng.randrange(60)) for _ in range(12)} | {rng.randrange(9)})))
    df = spark.createDataFrame(rows, "id long, system string, tokens array<long>")
    got = subset.varied_subset(Scratch(spark), df, 40, part=240).collect()
    import numpy as np

    whole = subset.local_search([np.asarray(t) for _, _, t in rows], np.array([s for _, s, _ in rows]), 40)
    best = dispersion([{"tokens": rows[i][2], "system": rows[i][1]} for i in whole])
    chance = sum(dispersion([{"tokens": t, "system": s} for _, s, t in rng.sample(rows, 40)]) for _ in range(10)) / 10
    covered = lambda sets: len({v for t in sets for v in t})
    assert len(got) == 40 and dispersion(got) > chance and dispersion(got) > 0.97 * best
    assert covered(r["tokens"] for r in got) > 1.2 * covered(t for _, _, t in rng.sample(rows, 40))


def test_long_trails_and_hubs_with_loops(spark):
    """Trails hanging on a core, trails by themselves, two chains between the same ends, a loop at one vertex."""
    hub = [(1, 1000 + i, 1.0) for i in range(50)]
    trail = [(1000 + i if i == 0 else 2000 + i, 2001 + i, 1.0) for i in range(30)]
    alone = [(5000 - i, 4999 - i, 1.0) for i in range(25)]
    twice = [(1, 6001, 1.0), (6001, 6002, 1.0), (6002, 2, 1.0), (1, 6003, 1.0), (6003, 2, 1.0), (2, 7, 1.0), (2, 8, 1.0)]
    loop = [(1, 8001, 1.0), (8001, 8002, 1.0), (8002, 1, 1.0)]
    _check_groups(spark, hub + trail + alone + twice + loop)
