"""Values at ranks, quantiles, splits and merged states against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import normalize as N
from cohortspark.operators import ordering as O
from cohortspark.operators import splits as S


def values(spark):
    rng = np.random.default_rng(4)
    by = {
        "many": np.concatenate([rng.normal(size=500), rng.normal(size=200) * 1e300, -rng.random(100) * 1e-300]), "ties": rng.integers(0, 4, 301).astype(float),
        "one": np.array([-0.0]), "ends": np.array([-np.inf, -1.5, 0.0, -0.0, 2.5, np.inf]), None: np.array([3.0, 1.0, 2.0]),
    }
    data = [(g, float(v)) for g, vs in by.items() for v in vs] + [("many", None), ("none", None)]
    return by, spark.createDataFrame(data, "g string, v double").repartition(5)


def test_quantiles_of_groups(spark):
    by, df = values(spark)
    probs = {"lo": 0.0, "q25": 0.25, "median": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r.g: r for r in O.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(by)
    for g, v in by.items():
        for name, p in probs.items():
            with np.errstate(invalid="ignore"):
                want = np.quantile(v, p)
            if np.isfinite(want):
                assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
    lower = {r.g: r.m for r in O.exact_quantiles(df, ["g"], "v", {"m": 0.5}, lower=True).collect()}
    assert all(lower[g] == np.sort(v)[(len(v) - 1) // 2] for g, v in by.items())
    whole = O.exact_quantiles(df.filter("g = 'ties'"), [], "v", {"m": 0.5}).first()
    assert whole.m == np.median(by["ties"]) and O.exact_quantiles(df.filter("false"), [], "v", {"m": 0.5}).first().m is None


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    r = O.exact_quantiles(df, [], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert (r.lo, r.mid) == (1.0, 2.0) and np.isnan(r.hi)


def test_no_rows_meet_by_group_alone(spark):
    """What is shuffled by a group are counts of one pass, not the rows."""
    _, df = values(spark)
    seen = O.with_image(df.dropna(), "v").withColumn("n", F.lit(1).cast("bigint"))
    plan = O.select_ranks(seen, ["g"], "_image", "n", {"m": lambda size: size / 2})._jdf.queryExecution().optimizedPlan().toString()
    assert 4 <= plan.count("Window [") <= 5 and "Join" in plan and "percentile" not in plan


@pytest.mark.parametrize("keep", [0, 1, 37, 100, 1000])
def test_cuts_by_draw_are_exact(spark, keep):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id long, g string")
    got = O.cut_by_draw(df, ["id"], 7, {"first": lambda n: F.lit(keep)}).collect()
    ranked = {r.id: r["rank"] for r in O.hash_rank(df, ["id"], 7).collect()}
    assert {r.id: r.first for r in got} == {i: k < keep for i, k in ranked.items()}
    by = O.cut_by_draw(df, ["id"], 7, {"first": lambda n: n / 5, "more": lambda n: n / 2}, ["g"]).collect()
    ranked = {r.id: r["rank"] for r in O.hash_rank(df, ["id"], 7, ["g"]).collect()}
    assert all(r.first == (ranked[r.id] < 10) and r.more == (ranked[r.id] < 25) for r in by)


def test_rows_that_share_a_draw_are_told_apart(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "id long")
    original = O.stable_draw
    try:
        O.stable_draw = lambda seed, *ids: (F.col("id") % 2).cast("bigint")
        got = {r.id: (r.two, r.five) for r in O.cut_by_draw(df, ["id"], 1, {"two": lambda n: F.lit(2), "five": lambda n: F.lit(5)}).collect()}
    finally:
        O.stable_draw = original
    assert got == {0: (True, True), 2: (True, True), 4: (False, True), 1: (False, True), 3: (False, True), 5: (False, False)}


def test_lookup_of_hot_keys_needs_no_driver(spark):
    rows = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(50)] + [(None,)], "patient_id string")
    split = spark.createDataFrame([("hot", "train")] + [(f"k{i}", "test") for i in range(49)], "patient_id string, split string")
    got = S.skew_safe_lookup(rows, split, "patient_id")
    assert {(r.patient_id, r.split): r["count"] for r in got.groupBy("patient_id", "split").count().collect()} == {
        ("hot", "train"): 500, **{(f"k{i}", "test"): 1 for i in range(49)}, ("k49", None): 1, (None, None): 1
    }


def test_states_of_parts_add_up(spark, folder):
    rng = np.random.default_rng(2)
    data = [(i, i % 3, float(1e6 + rng.normal()), bool(i % 5), None if i % 7 == 0 else float(i), True) for i in range(200)]
    df = spark.createDataFrame(data, "stay_id long, part int, x double, x_mask boolean, y double, y_mask boolean").withColumn("split", F.lit("train"))
    whole = {r.feature: r for r in N.feature_stats(df, ["x", "y"]).collect()}
    parts = {r.feature: r for r in N.stats_of(N.merged_states(N.feature_states(df, ["x", "y"], by=["part"]).drop("part"))).collect()}
    for f in ("x", "y"):
        assert (parts[f].n_obs, parts[f].feature_idx) == (whole[f].n_obs, whole[f].feature_idx)
        assert parts[f].mean == pytest.approx(whole[f].mean, rel=1e-12) and parts[f].std == pytest.approx(whole[f].std, rel=1e-9)
    for k in range(3):
        stats = N.updated_stats(spark, f"{folder}/states", df.filter(f"part = {k}"), ["x", "y"], str(k))
    assert {r.feature: r.std for r in stats.collect()} == pytest.approx({f: whole[f].std for f in ("x", "y")}, rel=1e-9)
    again = N.updated_stats(spark, f"{folder}/states", df.filter("false"), ["x", "y"], "2")  # a written part is not read again
    assert {r.feature: r.n_obs for r in again.collect()} == {f: whole[f].n_obs for f in ("x", "y")}
    empty = N.stats_of(N.feature_states(df.filter("false"), ["x"])).first()
    assert (empty.n_obs, empty.mean, empty.std) == (0, 0.0, 1.0)
