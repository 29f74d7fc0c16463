"""Resampling weights and metrics by weighted sums against plain resamples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import resampling as RS
from cohortspark.operators import significance as SG


def rows(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    p, y = np.round(rng.random(n), 2), (rng.random(n) < 0.3).astype(int)
    data = [(i, "ab"[i % 2], float(p[i]), float(np.round(1 - p[i], 2)), int(y[i])) for i in range(n)]
    return data, spark.createDataFrame(data, "stay_id long, g string, prediction double, other double, label int")


def test_weights_are_poisson_for_any_count():
    key = np.arange(1, 20_001, dtype=np.int64) * 104_729 % RS.PRIME
    for count in (1, 2, 3, 700, 2_000):
        n = 4 if count > 100 else 20
        w = RS.weights(key[: 2000 if count > 100 else 20_000], np.full(2000 if count > 100 else 20_000, count), n)
        assert abs(w.mean() / count - 1) < 0.02 and abs(w.var() / count - 1) < 0.08
        between = np.corrcoef(w.T)
        assert np.abs(between - np.eye(n)).max() < 0.08
    assert (RS.weights(key[:10], np.zeros(10, np.int64), 5) == 0).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_each_replicate_is_the_metric_of_its_resample(spark, parts):
    data, df = rows(spark)
    states = RS.metric_states()
    names = ["accuracy", "precision", "recall", "specificity", "f1", "brier_score", "ece", "mae", "rmse", "r2", "positive_rate"]
    got = {(r.g, r.replicate): r for r in RS.replicates(df.repartition(parts), {k: states[k] for k in names}, 6, 5, ["g"]).collect()}
    cells = df.groupBy("g", "prediction", "label").agg(F.count("*").alias("c")).withColumn("h", RS.cell_key(5, ["g"], ["prediction", "label"])).collect()
    for g in "ab":
        own = [r for r in cells if r.g == g]
        w = RS.weights(np.array([r.h for r in own]), np.array([r.c for r in own]), 6)
        w = np.concatenate([np.array([[r.c] for r in own]), w], axis=1)
        p0, y0 = np.array([r.prediction for r in own]), np.array([r.label for r in own])
        for k in range(7):
            p, y = np.repeat(p0, w[:, k]), np.repeat(y0, w[:, k])
            hit = p >= 0.5
            tp, fp, tn, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
            bins = np.minimum(np.floor(p * 15), 14)
            want = {
                "accuracy": (tp + tn) / len(y), "precision": tp / (tp + fp), "recall": tp / (tp + fn), "specificity": tn / (tn + fp),
                "f1": 2 * tp / (2 * tp + fp + fn), "brier_score": ((p - y) ** 2).mean(), "mae": np.abs(p - y).mean(), "rmse": np.sqrt(((p - y) ** 2).mean()),
                "r2": 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), "positive_rate": y.mean(),
                "ece": sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(15)) / len(y),
            }
            for name in names:
                assert got[g, k][name] == pytest.approx(want[name], abs=1e-9), (g, k, name)


def test_empty_single_class_and_null_rows(spark):
    states = RS.metric_states()
    df = spark.createDataFrame([("a", 0.9, 0), ("a", 0.8, 0), ("b", None, 1), ("b", 0.5, None)], "g string, prediction double, label int")
    got = {(r.g, r.metric): r for r in SG.bootstrap_intervals(df, {k: states[k] for k in ("recall", "r2", "mse")}, 20, 1, ["g"]).collect()}
    assert set(got) == {("a", "recall"), ("a", "r2"), ("a", "mse")}  # the rows of b have no number to score
    assert got["a", "recall"].point == 0.0 and np.isnan(got["a", "r2"].point) and got["a", "r2"].n_valid == 0
    assert SG.bootstrap_intervals(df.filter("false"), {"mse": states["mse"]}, 5, 1).count() == 0


def test_a_metric_of_ones_own_and_array_scores(spark):
    _, df = rows(spark)
    scored = df.withColumn("prediction", F.array("prediction", "other"))

    def hits(frame):
        top = np.stack(frame["prediction"].to_numpy()).argmax(axis=1)
        return np.stack([np.ones(len(frame)), top == frame["label"].to_numpy()], axis=1)

    own = RS.WeightedSums(2, hits, lambda s: s[:, 1] / s[:, 0])
    r = SG.bootstrap_ci(scored, own, n=50).first()
    want = df.agg(F.avg(F.when(F.col("prediction") >= F.col("other"), 0).otherwise(1).eqNullSafe(F.col("label")).cast("int"))).first()[0]
    assert r.point == pytest.approx(want) and r.ci_lower < want < r.ci_upper and r.metric == "value" and r.n_valid == 50


def test_paired_test_of_any_metric(spark):
    rng = np.random.default_rng(1)
    data = [(i, int(y), float(np.clip(0.3 + 0.4 * y + rng.normal(0, 0.2), 0, 1)), float(rng.random())) for i, y in enumerate(rng.random(400) < 0.4)]
    df = spark.createDataFrame(data, "stay_id long, label int, a double, b double")
    for metric, up in (("f1", True), ("ece", False), (RS.metric_states(0.4)["specificity"], True)):
        assert SG.paired_bootstrap(df, metric, "a", "b", n=80, higher_is_better=up).first().p_value < 0.05
        r = SG.paired_bootstrap(df, metric, "a", "a", n=80, higher_is_better=up).first()
        assert (r.delta, r.p_value, r.n_valid) == (0.0, 1.0, 80)
    none = SG.paired_bootstrap(df.filter("false"), "f1", "a", "b", n=5)
    assert none.count() <= 1
