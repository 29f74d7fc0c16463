import json

import pytest
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark import schemas
from cohortspark.operators import combine as U
from cohortspark.operators import gates as G
from cohortspark.operators import results as R
from cohortspark.functions import values as V

BASE = {
    "experiment_class": "core_ssl_benchmark", "paradigm": "mae", "dataset": "miiv", "seed": 42,
    "task": {"task_name": "mortality_24h"}, "training": {"freeze_encoder": True},
    "encoder": {"d_model": 64, "n_layers": 2}, "optimizer": {"lr": 0.001},
}


def run(i, config=None, tags=(), summary=None, name="run", created="2024-01-01"):
    return (str(i), "", name, "g", created, list(tags), json.dumps(BASE if config is None else config),
            summary if summary is not None else {"test/auprc": "0.5"}, "finished")


def flat(spark, *runs):
    return R.flatten_runs(spark.createDataFrame(list(runs), schemas.RUNS))


def test_flattening_rules(spark):
    xgb = {k: v for k, v in BASE.items() if k not in ("experiment_class", "training")} | {
        "paradigm": "xgboost", "xgboost": {"learning_rate": 0.1}}
    ssl = {**BASE, "ssl": {"name": "jepa", "mask_ratio": 0.5}, "protocol": "B"}
    del ssl["paradigm"]
    rows = {r["run_id"]: r for r in flat(
        spark,
        run(1, summary={"test/auprc": "0.5", "test/x": "NaN", "train/loss": "inf", "other": "3", "epoch": "9", "fairness/gender/auroc_gap": "0.1"}),
        run(2, xgb, ["experiment_class:classical_baselines", "commit:abc"], name="r_from_eicu_s1"),
        run(3, ssl, ["protocol:probe"]), run(4, {}, []),
        run(5, {**BASE, "output_dir": "x_lr00005"}), run(6, {**BASE, "encoder": {"d_model": 96, "n_layers": 3}}),
    ).collect()}
    assert rows["1"]["metrics"] == {"test/auprc": 0.5, "epoch": 9.0, "fairness/gender/auroc_gap": 0.1}
    assert rows["1"]["protocol"] == C.LINEAR_PROBE and rows["1"]["model_size"] == "default" and rows["1"]["seed"] == 42
    assert rows["1"]["fairness_keys"] == ["fairness/gender/auroc_gap"] and rows["1"]["phase"] == "finetune"
    two = rows["2"]
    assert (two["experiment_class"], two["phase"], two["protocol"], two["lr"], two["source_dataset"], two["launch_commit"]) == (
        "classical_baselines", "baseline", C.FULL_FINETUNE, 0.1, "eicu", "abc")
    assert rows["3"]["paradigm"] == "jepa" and rows["3"]["protocol"] == C.FULL_FINETUNE and rows["3"]["mask_ratio"] == 0.5
    assert rows["4"]["experiment_class"] is None and R.missing_class(flat(spark, run(4, {}, []))).count() == 1
    assert (rows["5"]["upstream_pretrain_lr"], rows["5"]["experiment_subtype"]) == (5e-4, "lr_sensitivity")
    assert rows["6"]["model_size"] == "d96_L3"


def test_per_seed_rules(spark):
    twice = [run(1), run(2, created="2024-02-01")]
    with pytest.raises(ValueError, match="repeated"):
        R.per_seed(flat(spark, *twice))
    assert [r["run_id"] for r in R.per_seed(flat(spark, *twice), allow_duplicates=True).collect()] == ["2"]
    other = run(3, {**BASE, "optimizer": {"lr": 0.01}})
    with pytest.raises(ValueError, match="share one"):
        R.per_seed(flat(spark, run(1), other), allow_duplicates=True)


def test_seed_interval(spark):
    rows = [("a", "m", x) for x in (1.0, 2.0, 4.0)] + [("b", "m", 3.0), ("c", "m", 5.0), ("c", "m", 5.0), ("d", "m", float("nan"))]
    df = spark.createDataFrame(rows, "k string, metric_name string, metric_value double")
    got = {r["k"]: r for r in R.aggregate_seeds(df, ["k"]).collect()}
    half = 4.302652729911275 * 1.5275252316519468 / 3**0.5
    assert got["a"]["ci95_lower"] == pytest.approx(7 / 3 - half) and got["a"]["n"] == 3
    assert got["b"]["std"] == 0.0 and got["b"]["ci95_lower"] != got["b"]["ci95_lower"]
    assert (got["c"]["ci95_lower"], got["c"]["ci95_upper"]) == (5.0, 5.0) and "d" not in got


def test_expected_matrix_counts(spark):
    full = R.expected_matrix(spark, with_pretrain=True)
    got = {r["experiment_class"]: r["n_rows"] for r in R.class_row_counts(full).collect()}
    # fixed values: the size of each class
    assert got == {"core_ssl_benchmark": 465, "label_efficiency": 1155, "cross_dataset_transfer": 120, "hp_robustness": 150,
                   "capacity_study": 100, "classical_baselines": 330, "ts2vec_extension": 135, "smart_external_reference": 135}
    keys = [*C.FINGERPRINT, "seed"]
    assert R.expected_matrix(spark).select(*keys).distinct().count() == R.expected_matrix(spark).count()


def test_matrix_and_seed_gates(spark):
    want = R.expected_matrix(spark).filter("experiment_class = 'capacity_study'")
    some = want.filter("seed <> 42").unionByName(want.limit(1).withColumn("dataset", F.lit("other")))
    got = {r["issue"]: r["n"] for r in G.matrix_differences(some, want).groupBy("issue").agg(F.count("*").alias("n")).collect()}
    assert got == {"missing": 18, "unexpected": 1}
    assert G.seed_set_issues(want, [k for k in C.FINGERPRINT]).count() == 0
    assert G.seed_set_issues(some.filter("dataset = 'miiv'"), [k for k in C.FINGERPRINT]).count() == 18


def test_paired_tests(spark):
    rows = []
    for seed in range(5):
        for task, metric in (("t1", "test/auprc"), ("t2", "test/auprc"), ("los_remaining", "test/mae")):
            for p, v in (("a", 0.5 + 0.1 * seed), ("b", 0.4 + 0.1 * seed), ("gru_d", 0.1)):
                if not (p == "b" and seed == 4):
                    rows.append(("core_ssl_benchmark", p, task, seed, "linear_probe", {metric: v}))
    df = spark.createDataFrame(rows, "experiment_class string, paradigm string, task string, seed bigint, protocol string, metrics map<string,double>") \
        .withColumns({"label_fraction": F.lit(1.0), "dataset": F.lit("miiv")})
    got = R.statistical_tests(df).collect()
    ab = {(r["comparison_scope"], r["task"], r["primary_metric_name"]): r for r in got if (r["paradigm_a"], r["paradigm_b"]) == ("a", "b")}
    omni = ab[("omnibus_primary_metric", None, "test/auprc")]
    assert omni["n_shared_pairs"] == 8 and omni["n_union_pairs"] == 10 and omni["better_paradigm"] == "a"
    assert omni["p_value"] == pytest.approx(2 / 2**8) and omni["p_value_bonferroni"] == pytest.approx(6 / 2**8)
    assert ab[("per_task", "los_remaining", "test/mae")]["better_paradigm"] == "b"
    assert ("omnibus_primary_metric", None, "test/mae") not in ab  # a single task


def test_context_pairs_are_mixed_only(spark):
    rows = [("classical_baselines" if p in C.CLASSICAL_PARADIGMS else "core_ssl_benchmark", p, "t", s, C.FULL_FINETUNE, {"test/auprc": v + s})
            for s in range(3) for p, v in (("gru_d", 0.1), ("xgboost", 0.2), ("mae", 0.3), ("jepa", 0.4))]
    df = spark.createDataFrame(rows, "experiment_class string, paradigm string, task string, seed bigint, protocol string, metrics map<string,double>") \
        .withColumn("label_fraction", F.lit(1.0))
    got = {(r["paradigm_a"], r["paradigm_b"]) for r in R.statistical_tests(df).filter("experiment_class = 'classical_context_full'").collect()}
    assert got == {("gru_d", "mae"), ("gru_d", "jepa"), ("jepa", "xgboost"), ("mae", "xgboost")} or got == {
        tuple(sorted(p)) for p in (("gru_d", "mae"), ("gru_d", "jepa"), ("xgboost", "mae"), ("xgboost", "jepa"))}


def test_provenance_reasons(spark):
    good = {"_eval_checkpoint_source": "best", "_eval_artifact_sha256": "d", "_best_ckpt_path": "/o/outputs/r/b.ckpt", "_best_ckpt_load_ok": "True"}
    fair = {"_fairness_summary_schema_version": C.FAIRNESS_SCHEMA_VERSION, "_fairness_script_version": C.FAIRNESS_SCRIPT_VERSION,
            "_fairness_protected_attributes": '["gender","age_group","race"]', "_fairness_min_subgroup_size": "50.0",
            "_fairness_artifact_source": "recorded_best", "_fairness_checkpoint_source": "best",
            "_fairness_artifact_path": "/other/outputs/r/b.ckpt", "_fairness_artifact_sha256": "d"}
    df = flat(spark, run(1, summary={**good, **fair}), run(2, summary={**good, "_best_ckpt_load_ok": "no"}),
              run(3, summary={"_eval_checkpoint_source": "failed", "_best_ckpt_error": "boom"}), run(4, summary={}))
    got = {r["run_id"]: r["reason"] for r in G.checkpoint_issues(df).collect()}
    assert got == {"2": "best checkpoint load not confirmed", "3": "checkpoint selection failed: boom", "4": "checkpoint source missing"}
    stale = {r["run_id"]: set(r["issues"]) for r in G.fairness_staleness(df).collect()}
    assert "1" not in stale and {"schema version", "artifact path missing"} <= stale["2"]


def test_fairness_requirements(spark):
    keys = {f"fairness/{a}/{m}": "1" for a in ("gender", "age_group") for m in C.BINARY_FAIRNESS_KEYS}
    los = {f"fairness/{a}/{m}": "1" for a in C.PROTECTED_ATTRIBUTES for m in C.REGRESSION_FAIRNESS_KEYS}
    df = flat(spark, run(1, {**BASE, "dataset": "eicu"}, summary=keys), run(2, summary=keys),
              run(3, {**BASE, "task": {"task_name": "los_remaining"}}, summary=los))
    got = {r["run_id"]: len(r["missing_keys"]) for r in G.fairness_gaps(df).collect()}
    assert got == {"2": len(C.BINARY_FAIRNESS_KEYS)}


def test_small_text_functions(spark):
    df = spark.createDataFrame([("/a/outputs/x/y/",), ("outputs/x",), ("b\\outputs\\x",), ("/plain/",), (" ",), (None,), ("xoutputs/q/outputs/z",)], "p string")
    assert [r[0] for r in df.select(V.artifact_id("p")).collect()] == ["outputs/x/y", "outputs/x", "outputs/x", "plain", "", "", "outputs/z"]
    a = spark.createDataFrame([('["g", "a", "g"]',), ("g, a ,g",), (" ",), (None,)], "t string")
    assert [r[0] for r in a.select(V.decode_attributes("t")).collect()] == [["g", "a"], ["g", "a"], None, None]


def test_metadata_gates():
    ok = {"seq_length_hours": 24, "min_stay_hours": 24, "label_horizon_hours": 48, "tasks": list(C.BENCHMARK_TASKS)}
    assert G.benchmark_metadata_issues(ok, ["hr"]) == []
    assert len(G.benchmark_metadata_issues({**ok, "seq_length_hours": 48, "tasks": []}, ["sofa"])) == 3


# --- combining -------------------------------------------------------------------------------

def side(spark, ids, age="int", extra=()):
    static = spark.createDataFrame([(i, p, 50) for i, p in ids], "stay_id bigint, patient_id bigint, age int").withColumn("age", F.col("age").cast(age))
    ts = static.select("stay_id", F.array(F.array(F.lit(1.0))).alias("timeseries"), F.array(F.array(F.lit(True))).alias("mask"))
    labels = static.select("stay_id", *[F.lit(1).alias(c) for c in extra])
    feats = spark.createDataFrame([(0, "hr"), (1, "sbp")], "position int, feature string")
    return {"static": static, "timeseries": ts, "labels": labels, "features": feats}


def test_combine(spark):
    out = U.combine(side(spark, [(1, 10)], extra=("t1",)), side(spark, [(1, 10), (2, 11)], "double", ("t2",)), ("miiv", "eicu"))
    got = sorted((r["stay_id"], r["patient_id"], r["source_dataset"]) for r in out["static"].collect())
    assert got == [(1, "miiv:10", "miiv"), (U.ID_OFFSET + 1, "eicu:10", "eicu"), (U.ID_OFFSET + 2, "eicu:11", "eicu")]
    assert dict(out["static"].dtypes)["age"] == "string" and out["labels"].columns == ["stay_id", "t1", "t2"]
    assert out["timeseries"].count() == 3


def test_combine_refuses_reordered_features_and_other_schemas(spark):
    a, b = side(spark, [(1, 1)]), side(spark, [(2, 2)])
    b["features"] = spark.createDataFrame([(0, "sbp"), (1, "hr")], "position int, feature string")
    with pytest.raises(G.GateError, match="features differ"):
        U.combine(a, b, ("x", "y"))
    b = side(spark, [(2, 2)])
    b["timeseries"] = b["timeseries"].drop("mask")
    with pytest.raises(G.GateError, match="schemas differ"):
        U.combine(a, b, ("x", "y"))


def test_stay_gate(spark):
    bad = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, None, -1.0)], "stay_id bigint, patient_id string, los_days double")
    with pytest.raises(G.GateError, match="n_duplicate_stay': 1"):
        G.check_stays(bad)
    G.check_stays(bad.limit(1))


def test_artifact_readiness(spark):
    s = side(spark, [(1, 1), (2, 2)])
    r = G.artifact_readiness(s["static"], s["timeseries"], s["labels"], 84).first()
    assert r["ready"] and r["n_unobserved"] == 0
    assert not G.artifact_readiness(s["static"], s["timeseries"].limit(1), s["labels"], 84).first()["ready"]
