import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.tdist import t_975, t_table
from cohortspark.operators import fairness as FA
from cohortspark.operators import metrics as ME
from cohortspark.operators import ordering as O
from cohortspark.operators import significance as SG


def scored(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("ab"), round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "stay_id bigint, g string, prediction double, label int")


def auroc(rows):
    pos = [p for *_, p, y in rows if y]
    neg = [p for *_, p, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def auprc(rows):
    total, out = sum(y for *_, y in rows), 0.0
    prev = 0
    for t in sorted({p for *_, p, _ in rows}, reverse=True):
        hit = [(p, y) for *_, p, y in rows if p >= t]
        tp = sum(y for _, y in hit)
        out += (tp - prev) / total * tp / len(hit)
        prev = tp
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_ranking_equals_pair_loop_on_any_partitioning(spark, parts):
    rows, df = scored(spark)
    got = {r["g"]: r for r in ME.ranking_metrics(df.repartition(parts), ["g"]).collect()}
    for g in "ab":
        mine = [r for r in rows if r[1] == g]
        assert got[g]["auroc"] == pytest.approx(auroc(mine), abs=1e-12)
        assert got[g]["auprc"] == pytest.approx(auprc(mine), abs=1e-12)
    whole = ME.ranking_metrics(df).first()
    assert whole["auroc"] == pytest.approx(auroc(rows), abs=1e-12) and whole["n"] == 300


def test_single_class_is_nan(spark):
    df = spark.createDataFrame([(1, 0.4, 1), (2, 0.9, 1)], "stay_id int, prediction double, label int")
    assert math.isnan(ME.ranking_metrics(df).first()["auroc"])


def test_metric_names_are_checked():
    assert ME.check_metric_names("binary") == ME.BINARY_METRICS
    assert ME.check_metric_names("multiclass") == ("auroc", "accuracy")
    assert ME.check_metric_names("multilabel") == ("auroc",)
    assert ME.check_metric_names("regression") == ("mse", "mae", "r2")
    assert ME.check_metric_names("regression", ["rmse"]) == ("rmse",)
    with pytest.raises(ValueError):
        ME.check_metric_names("binary", ["mse"])
    with pytest.raises(ValueError):
        ME.check_metric_names("other")


def test_calibration_bin_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (1 / 15, 1)], "prediction double, label int")
    got = {r["bin"]: r["n"] for r in ME.calibration_bins(df).collect()}
    assert got == {0: 1, 14: 1, 1: 1}


def test_running_totals_and_quantiles_with_a_hot_group(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", rnd.choice([1.0, 2.0, 2.5, rnd.random() * 9])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = {"a": 0.1, "m": 0.5, "z": 1.0}
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], "v", probs, buckets=16).collect()}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g)
        for name, p in probs.items():
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))
    low = O.exact_quantiles(df, [], "v", {"m": 0.5}, lower=True).first()["m"]
    assert low == sorted(x for _, x in rows)[(len(rows) - 1) // 2]


def test_hash_rank_is_a_permutation_and_partition_free(spark):
    ids = spark.range(500).withColumnRenamed("id", "stay_id")
    a = {r["stay_id"]: r["rank"] for r in O.hash_rank(ids.repartition(1), ["stay_id"], 7).collect()}
    b = {r["stay_id"]: r["rank"] for r in O.hash_rank(ids.repartition(9), ["stay_id"], 7).collect()}
    assert a == b and sorted(a.values()) == list(range(500))


def exact_p(diffs):
    """Two-sided exact p by listing all signs (no ties)."""
    r = {d: i + 1 for i, d in enumerate(sorted(abs(x) for x in diffs))}
    up = sum(r[abs(x)] for x in diffs if x > 0)
    n = len(diffs)
    w = min(up, n * (n + 1) // 2 - up)
    below = sum(sum(c) <= w for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k))
    return min(1.0, 2 * below / 2**n)


def signed(spark, families):
    rows = [(k, float(d)) for k, ds in families.items() for d in ds]
    df = spark.createDataFrame(rows, "k string, diff double")
    return {r["k"]: r for r in SG.signed_rank(df, ["k"]).collect()}


def test_signed_rank_small_families(spark):
    fam = {
        "equal": [0.1] * 5, "mixed": [1.5, -0.5, 2.5, 3.0, -1.0, 4.0], "one": [2.0], "zero": [0.0, 0.0],
        "gone": [float("nan")],
    }
    got = signed(spark, fam)
    assert got["equal"]["p_value"] == pytest.approx(0.0625)
    assert got["mixed"]["p_value"] == pytest.approx(exact_p(fam["mixed"]))
    assert got["one"]["p_value"] == 1.0
    assert got["zero"]["p_value"] == 1.0 and got["zero"]["n_nonzero_pairs"] == 0
    assert math.isnan(got["gone"]["p_value"]) and got["gone"]["n_pairs"] == 0


def test_signed_rank_large_family_uses_the_normal_curve(spark):
    rnd = random.Random(2)
    d = [round(rnd.gauss(0.15, 1), 1) for _ in range(80)]
    got = signed(spark, {"k": d})["k"]
    nz = [x for x in d if x]
    absd = sorted(abs(x) for x in nz)
    rank = {v: (absd.index(v) + 1 + len(absd) - absd[::-1].index(v)) / 2 for v in set(absd)}
    up = sum(rank[abs(x)] for x in nz if x > 0)
    n = len(nz)
    ties = sum(absd.count(v) ** 3 - absd.count(v) for v in set(absd))
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (up - mean - math.copysign(0.5, up - mean)) / sd
    assert got["z_score"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)


def test_normal_tail_and_t_quantiles(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 2.9, 3.1, 5.0, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", SG.normal_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-8)
    # fixed values of the quantile, from any statistics table
    assert t_table()[0] == pytest.approx(12.7062047) and t_table()[29] == pytest.approx(2.0422725)
    got = spark.range(1).select(t_975(F.lit(4)).alias("a"), t_975(F.lit(120)).alias("b"), t_975(F.lit(0)).alias("c")).first()
    assert got["a"] == pytest.approx(2.7764451) and got["b"] == pytest.approx(1.9799304) and got["c"] is None


def test_bootstrap_is_repeatable_and_sane(spark):
    rows, df = scored(spark, 400)
    for metric in ("accuracy", "auroc"):
        a = SG.bootstrap_ci(df.repartition(1), metric, n=120, seed=1).first()
        b = SG.bootstrap_ci(df.repartition(7), metric, n=120, seed=1).first()
        assert a["ci_lower"] == pytest.approx(b["ci_lower"]) and a["ci_upper"] == pytest.approx(b["ci_upper"])
        assert a["ci_lower"] < a["point"] < a["ci_upper"]
    own = SG.bootstrap_ci(
        df, lambda d: d.groupBy("replicate").agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("value")),
        n=50,
    ).first()
    assert own["ci_lower"] < own["point"] < own["ci_upper"]


def test_paired_bootstrap_finds_the_better_score(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(500):
        y = int(rnd.random() < 0.4)
        rows.append((i, y, min(1.0, max(0.0, 0.3 + 0.4 * y + rnd.gauss(0, 0.15))), rnd.random()))
    df = spark.createDataFrame(rows, "stay_id bigint, label int, a double, b double")
    for metric, up in (("auroc", True), ("mse", False)):
        r = SG.paired_bootstrap(df, metric, "a", "b", n=100, higher_is_better=up).first()
        assert r["p_value"] < 0.05 and r["significant_at_005"]
        r = SG.paired_bootstrap(df, metric, "b", "a", n=100, higher_is_better=up).first()
        assert r["p_value"] > 0.5


def test_bonferroni_keeps_nan(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.4), ("f", float("nan"))], "k string, p_value double")
    got = [r["p_value_bonferroni"] for r in SG.bonferroni(df, ["k"]).collect()]
    assert sorted(x for x in got if x == x) == [0.02, 0.8] and sum(x != x for x in got) == 1


def test_cohens_d_edges(spark):
    df = spark.createDataFrame(
        [("same", 1.0, 1.0), ("same", 2.0, 2.0), ("shift", 2.0, 1.0), ("shift", 3.0, 2.0), ("one", 1.0, 0.0)],
        "k string, value_a double, value_b double",
    )
    got = {r["k"]: r["cohens_d"] for r in SG.cohens_d(df, ["k"]).collect()}
    assert got["same"] == 0.0 and got["shift"] == math.inf and math.isnan(got["one"])


# --- fairness -----------------------------------------------------------------------------

def test_parity_edges(spark):
    rows = [("a", "x", 0.9, 1), ("a", "x", 0.1, 0), ("a", "y", 0.6, 1), ("a", "y", 0.7, 0),
            ("b", "x", 0.9, 1), ("b", "y", 0.9, 1), ("c", "x", 0.9, 1), ("d", "x", 0.1, 0), ("d", "y", 0.1, 1)]
    df = spark.createDataFrame(rows, "attr string, group string, prediction double, label int")
    got = {r["attr"]: r for r in FA.parity(FA.subgroup_rates(df)).collect()}
    assert got["a"]["demographic_parity_diff"] == 0.5 and got["a"]["equalized_odds_diff"] == 1.0
    assert got["a"]["four_fifths_violation"]
    assert math.isnan(got["b"]["equalized_odds_diff"])
    assert (got["c"]["demographic_parity_diff"], got["c"]["disparate_impact_ratio"]) == (0.0, 1.0)
    assert got["d"]["disparate_impact_ratio"] == 1.0


def test_groups_and_minimum_size(spark):
    static = spark.createDataFrame(
        [(1, 10, "male", 30.0), (2, 10, "M", 44.5), (3, 11, "Female", 17.0), (4, 12, "f", 90.0), (5, 13, "N/A", 50.0)],
        "stay_id bigint, patient_id bigint, gender string, age double",
    )
    pred = static.select("stay_id", F.lit(0.5).alias("prediction"), F.lit(1).alias("label"))
    rows = FA.with_groups(pred, static, FA.available_attributes(static))
    sizes = {(r["attr"], r["group"]): (r["n_patients"], r["n_stays"]) for r in FA.group_sizes(rows, 1).collect()}
    assert sizes == {("gender", "M"): (1, 2), ("gender", "F"): (2, 2), ("age_group", "18-44"): (1, 1),
                     ("age_group", "80+"): (1, 1), ("age_group", "45-64"): (1, 1)}
    kept = FA.valid_rows(rows, FA.group_sizes(rows, 2))
    assert kept.count() == 0  # one valid gender group only, so the attribute is skipped


def test_race_availability(spark):
    one = spark.createDataFrame([(1, "WHITE", "miiv")], "stay_id bigint, race string, source_dataset string")
    assert FA.available_attributes(one, dataset="eicu") == []
    assert FA.available_attributes(one, dataset="combined") == ["race"]
    assert FA.available_attributes(one.drop("source_dataset"), dataset="combined") == []
    assert FA.available_attributes(one.withColumn("source_dataset", F.lit("eicu")), dataset="combined") == []


def test_binary_fairness_single_class_groups(spark):
    rows = [("gender", g, i, 0.1 * i, y) for g, ys in (("F", [0, 1, 0]), ("M", [1, 1, 1])) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "attr string, group string, patient_id int, prediction double, label int") \
        .withColumn("stay_id", F.monotonically_increasing_id())
    r = FA.binary_fairness(df, 1).first()
    assert math.isnan(r["worst_group_auroc"]) and math.isnan(r["equalized_odds_diff"])
    assert (r["n_valid_groups"], r["n_metric_valid_groups"], r["n_single_class_groups"]) == (2, 1, 1)
    keys = {x["key"] for x in FA.flat_keys(FA.long_report(FA.binary_fairness(df, 1), FA.binary_group_scores(df, 1))).collect()}
    assert {"fairness/gender/auroc_gap", "fairness/gender/per_group_auroc/F"} <= keys


def test_replicates_equal_a_plain_resample(spark):
    """Every replicate is the metric of the rows repeated by their weights."""
    import numpy as np

    rows, df = scored(spark, 120, seed=9)
    cells = df.groupBy(F.col("label").alias("_y"), "prediction").agg(F.count("*").alias("c"))
    cells = cells.withColumn("h", F.xxhash64(F.lit(5), "_y", "prediction")).collect()
    h = np.array([r["h"] for r in cells], dtype="int64").view(np.uint64)
    w = SG.cell_weights(h, np.array([r["c"] for r in cells]), 6)
    got = {r["replicate"]: r for r in SG.replicate_ranking(df.repartition(3), 6, 5).collect()}
    for k in range(6):
        sample = [(0, 0, r["prediction"], r["_y"]) for r, m in zip(cells, w[:, k]) for _ in range(m)]
        assert got[k + 1]["auroc"] == pytest.approx(auroc(sample), abs=1e-12)
        assert got[k + 1]["auprc"] == pytest.approx(auprc(sample), abs=1e-12)
