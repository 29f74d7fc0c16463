import math

import pytest
from pyspark.sql import functions as F

import check_queries as CQ
from cohortspark.operators import embeddings as EM
from cohortspark.operators import masking as K
from cohortspark.operators import normalize as N
from cohortspark.operators import windows as WI
from tests.test_grid_windows import random_dense


def runs(flags):
    return sum(1 for i, f in enumerate(flags) if not f and (i == 0 or flags[i - 1]))


def test_budget_and_blocks(spark):
    dense = random_dense(spark, n=60, length=24, seed=5)
    for r in K.block_timestep_mask(dense, 0.5, 3, seed=2).collect():
        valid = [any(m) for m in r["mask"]]
        seen = [v for v, ok in zip(r["visible"], valid) if ok]
        n = len(seen)
        want = 0 if n <= 1 else min(max(int(n * 0.5 + 0.5), 1), n - 1)
        assert seen.count(False) == want and all(v for v, ok in zip(r["visible"], valid) if not ok)
        if want:
            assert runs(seen) == min(3, want, n - want + 1)
    a = K.timestep_mask(dense.repartition(1), 0.4, 1).select("stay_id", "visible").collect()
    b = K.timestep_mask(dense.repartition(6), 0.4, 1).select("stay_id", "visible").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_contiguous_blocks(spark):
    dense = random_dense(spark, n=40, length=48, seed=6)
    for r in K.contiguous_block_mask(dense, 0.5, seed=1).collect():
        hidden = r["visible"].count(False)
        assert 24 - 2 <= hidden <= 24
    assert all(all(r["visible"]) for r in K.contiguous_block_mask(dense, 0.02).collect())


def test_views_are_complements(spark):
    dense = random_dense(spark, n=50, length=12, seed=7)
    for ratio in (0.0, 0.5, 0.9):
        for r in K.complementary_views(K.timestep_mask(dense, ratio)).collect():
            valid = [i for i, m in enumerate(r["mask"]) if any(m)]
            a, b = ([i for i in valid if r[c][i]] for c in ("visible", "visible_2"))
            if len(valid) == 1:
                assert a == b == valid
            elif valid:
                assert a and b and sorted(a + b) == valid


@pytest.mark.parametrize("name", ["group_cell_masks", "masked_fill", "token_mask", "holdout_masks"])
def test_queries_notice_masks_that_are_off(spark, sf, name, monkeypatch):
    con = CQ.duck(sf)
    assert CQ.compare(spark, con, name, sf)[0]
    monkeypatch.setattr(K, "stable_uniform", lambda seed, *cols: F.lit(2.0))
    assert not CQ.compare(spark, con, name, sf)[0]


def test_tokens_keep_one_visible(spark):
    t = WI.observed_tokens(random_dense(spark, n=30))
    for r in K.token_mask(t, 1.0).collect():
        assert sum(r["visible"]) == (1 if r["n_obs"] else 0)


def test_holdout_feature_block(spark):
    rows = [(s, h, f, 1.0, True) for s in range(20) for h in range(6) for f in ("a", "b", "c", "d")]
    cells = spark.createDataFrame(rows, "stay_id bigint, hour int, feature_name string, value double, observed boolean")
    held = K.holdout(cells, "feature_block", 0.5, 4, 6).filter("held_out")
    per = held.groupBy("stay_id").agg(F.count_distinct("feature_name").alias("k"), F.count("*").alias("n")).collect()
    assert len(per) == 20 and all((r["k"], r["n"]) == (2, 12) for r in per)
    span = K.holdout(cells, "temporal_block", 0.5, 4, 6).filter("held_out").groupBy("stay_id").agg(
        (F.max("hour") - F.min("hour") + 1).alias("w"), F.count_distinct("hour").alias("k")).collect()
    assert all(r["w"] == r["k"] == 3 for r in span)


def test_normalization_policies(spark):
    rows = [(i, 0, float(i), True, 5.0, True, None, False, "train") for i in range(4)]
    rows += [(9, 0, float("inf"), True, 5.0, True, None, False, "train"), (8, 0, 99.0, True, 0.0, True, 1.0, True, "test")]
    df = spark.createDataFrame(rows, "stay_id bigint, hour int, a double, a_mask boolean, b double, b_mask boolean, c double, c_mask boolean, split string")
    got = {r["feature"]: r for r in N.feature_stats(df, ["a", "b", "c"]).collect()}
    assert got["a"]["mean"] == 1.5 and got["a"]["n_obs"] == 4
    assert got["b"]["std"] == 1.0 and (got["c"]["mean"], got["c"]["std"], got["c"]["n_obs"]) == (0.0, 1.0, 0)
    clamp = {r["feature"]: r for r in N.feature_stats(df.filter("a < 10"), ["b", "c"], "clamp").collect()}
    assert clamp["b"]["std"] == 1e-6 and clamp["c"]["std"] == 1.0


def test_embedding_spectrum_and_collapse(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6)) + 1e-3 * rng.normal(size=(200, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "id bigint, embedding array<double>").repartition(4)
    ev = [r["eigenvalue"] for r in EM.eigenvalues(df).orderBy("component").collect()]
    want = np.sort(np.linalg.eigvalsh(np.cov(base.T)))[::-1]
    assert np.allclose(ev, want, rtol=1e-6, atol=1e-12)
    d = EM.dimensionality(EM.eigenvalues(df)).first()
    assert d["variance_95_dims"] <= 2 and 1 <= d["effective_rank"] <= 2.1
    flat = spark.createDataFrame([(i, [1.0, 2.0 + 1e-3 * i, 0.0]) for i in range(50)], "id bigint, embedding array<double>")
    r = EM.quality_report(flat, "id", n_pairs=300).first()
    assert r["is_collapsed"] and r["dead_dimensions"] == 2 and "collapsed" in r["warnings"]
    pairs = EM.sampled_pairs(flat, 300, "id")
    assert pairs.count() == 300 and pairs.filter("u = v").count() == 0
    assert math.isclose(EM.global_stats(flat).first()["global_mean"], float(np.mean([[1.0, 2.0 + 1e-3 * i, 0.0] for i in range(50)])))


def test_split_hash_ignores_order(spark):
    df = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(60)], "stay_id bigint, split string")
    a = N.split_hash(df.repartition(1)).first()["split_hash"]
    assert a == N.split_hash(df.orderBy(F.desc("stay_id")).repartition(5)).first()["split_hash"]
    assert a != N.split_hash(df.filter("stay_id <> 1")).first()["split_hash"]
    assert a == N.split_hash(df.filter("stay_id <> 0")).first()["split_hash"]  # a test stay
