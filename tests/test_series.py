import math

import numpy as np

from covermill.plans import queries


def test_every_two_kinds_correlate(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = {k: rng.normal(size=6).tolist() for k in ("click", "error", "purchase", "view")}
    rows = [(1, k, f"2024-01-01 00:00:0{i}", v) for k, vs in values.items() for i, v in enumerate(vs)] + [(2, "view", "2024-01-01 00:00:00", 1.0), (1, None, "2024-01-01 00:00:00", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").selectExpr("user_id", "event_type", "cast(ts as timestamp) as ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["kind_a"], r["kind_b"]): (r["n"], r["pearson"]) for r in queries.user_correlation(spark, str(tmp_path)).collect()}
    want = {(1, a, b): np.corrcoef(values[a], values[b])[0, 1] for a in values for b in values if a < b}
    assert set(got) == set(want)
    assert all(got[k][0] == 6 and math.isclose(got[k][1], v, abs_tol=1e-6) for k, v in want.items())


def test_every_run_is_compared(spark, tmp_path):
    spark.createDataFrame([(r, k + 1, "p", s, c) for r, picks in (("a", ((1, 2), (2, 3))), ("b", ((2, 2), (1, 9))), ("c", ((3, 1),))) for k, (s, c) in enumerate(picks)], "run_id string, pick_rank long, source string, source_idx long, covered long").write.parquet(f"{tmp_path}/initial_training_manifest.parquet")
    spark.createDataFrame([(10 + i, "p", i) for i in (1, 2, 3)], "struct_id long, source string, source_idx long").write.parquet(f"{tmp_path}/structures.parquet")
    spark.createDataFrame([(11, "x"), (11, "y"), (12, "y"), (12, "z"), (13, "z")], "struct_id long, env string").write.parquet(f"{tmp_path}/struct_envs.parquet")
    got = {tuple(r) for r in queries.run_comparisons(spark, str(tmp_path)).collect()}
    assert got == {("a", 1, 2, 2, 0), ("a", 2, 3, 3, 0), ("b", 1, 2, 2, 0), ("b", 2, 9, 3, 6), ("c", 1, 1, 1, 0)}
