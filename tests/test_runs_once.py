"""Run tables store and read only what they need, and compute it once per row."""

from cohortspark import config as C
from cohortspark.functions import values as V
from cohortspark.operators import gates as G
from cohortspark.operators import results as R
from cohortspark.plans import queries_runs as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_named_columns_are_stored(spark, sf):
    assert Q.flat(spark, sf, "task").columns == ["task"]
    keys = {*C.FINGERPRINT, "seed", "created_at", "run_id"}
    assert set(Q.latest(spark, sf).columns) == keys and set(Q.latest(spark, sf, "metrics").columns) == keys | {"metrics"}


def test_a_matrix_difference_reads_each_side_once(spark):
    schema = "a string, b double, seed bigint"
    seen = spark.createDataFrame([("x", 1.0, 1), ("x", 1.0, 1), (None, None, 2), ("y", float("nan"), 3), (" ", 0.1, None)], schema)
    want = spark.createDataFrame([("x", 1.0, 1), (None, None, 2), ("y", None, 3), ("z", 0.5, 4)], schema)
    out = G.matrix_differences(seen, want, ["a", "b", "seed"])
    assert {tuple(r) for r in out.collect()} == {("z", 0.5, 4, "missing"), (None, 0.1, None, "unexpected")}
    assert plan(out).count("LogicalRDD") == 2


def test_a_view_reads_its_rows_once(spark):
    cells = ("core_ssl_benchmark", "label_efficiency", "capacity_study", "classical_baselines", None)
    rows = [
        (f"{k}-{f}", k, "mae", "miiv", "mortality_24h", "full_finetune", f, "default", None, "finetune")
        for k in cells for f in (1.0, 0.1, None, float("nan"))
    ]
    df = spark.createDataFrame(
        rows, "run_id string, experiment_class string, paradigm string, dataset string, task string, protocol string, "
        "label_fraction double, model_size string, source_dataset string, phase string")
    one, low = C.CONTEXT_CLASSES
    got = {(r["comparison_view"], r["experiment_class"], r["run_id"]) for r in R.classical_views(df).collect()}
    assert got == {(one, one, f"{k}-{f}") for k in ("core_ssl_benchmark", "classical_baselines") for f in (1.0, None)} | {
        (low, low, f"{k}-0.1") for k in ("label_efficiency", "classical_baselines")}
    own = {r["run_id"] for r in R.label_efficiency_view(df).collect()}
    assert own == {f"label_efficiency-{f}" for f in (1.0, 0.1, None, float("nan"))} | {"core_ssl_benchmark-1.0", "core_ssl_benchmark-None"}
    for view in (R.classical_views, R.label_efficiency_view, R.capacity_view):
        assert plan(view(df)).count("LogicalRDD") == 1


def test_a_filter_on_a_column_does_not_compute_it_again(spark):
    df = spark.createDataFrame([("a/outputs/x",), ("",), (None,)], "p string")
    out = V.once(df, at=V.artifact_id("p")).filter("at != ''")
    assert [r["at"] for r in out.collect()] == ["outputs/x"]
    assert [s for s in plan(out).splitlines() if "Filter" in s and "instr" in s] == []


def test_the_config_is_parsed_once(spark, sf):
    shown = plan(Q.recovered_metadata(spark, sf))
    assert "get_json_object" not in shown and shown.count("from_json") + shown.count("JsonToStructs") <= 1


def test_metrics_keep_finite_numbers_only(spark):
    summary = {"test/a": "NaN", "test/b": "-inf", "test/c": "x", "test/d": "1e3", "note": "1", "fairness/z/b": "2", "fairness/a/b": "n"}
    row = ("1", "", "r", "g", "2024-01-01", [], "{}", summary, "finished")
    from cohortspark import schemas

    got = R.flatten_runs(spark.createDataFrame([row], schemas.RUNS)).select("metrics", "fairness_keys").first()
    assert got["metrics"] == {"test/d": 1000.0, "fairness/z/b": 2.0} and got["fairness_keys"] == ["fairness/a/b", "fairness/z/b"]


def test_only_the_newest_runs_are_stored(spark, sf):
    rows = Q.latest(spark, sf)
    assert "Window" not in plan(rows) and rows.count() == rows.select(*C.FINGERPRINT, "seed").distinct().count()


def test_the_newest_run_is_found_by_a_hash_of_its_key(spark):
    rows = [
        ("a", 0.0, 1, "2024-01-01", "1"), ("a", -0.0, 1, "2024-01-02", "2"), ("a", 1.0, 1, None, "9"), ("a", 1.0, 1, "2024-01-01", "3"),
        (None, float("nan"), None, "2024-01-01", "4"), (None, float("nan"), None, "2024-01-01", "5"), (None, None, None, None, "6"),
        ("", None, None, "2024-01-01", None), ("a", 0.0, 2, "2024-01-01", "7"), ("a", 0.0, 2, "2024-01-01", "7"),
    ]
    df = spark.createDataFrame(rows, "paradigm string, label_fraction double, seed bigint, created_at string, run_id string")
    out = R.latest_runs(df)
    assert out.columns == ["paradigm", "label_fraction", "seed", "created_at", "run_id"]
    assert sorted(str(r["run_id"]) for r in out.collect()) == ["2", "3", "5", "6", "7", "None"]
    sort = [s for s in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in s]
    assert sort and all("Sort [_hash" in s for s in sort)
    assert R.latest_runs(df.select("created_at", "run_id")).first()["run_id"] == "2"


def test_a_tag_and_a_name_are_read_once(spark):
    from cohortspark import schemas

    def run(name, config, *tags):
        return ("1", "", name, "g", "2024-01-01", list(tags), config, {}, "finished")

    df = spark.createDataFrame(
        [
            run("x_from_miiv_lr00005", "{}", "experiment_class:k", "protocol:Probe", "phase:p"),
            run("x_from_eicu", '{"paradigm": "xgboost", "protocol": "fine-tune", "output_dir": "/o/x_mask_ratio075"}'),
            run(None, '{"training": {"freeze_encoder": true}, "output_dir": "a_from_combined"}', "protocol: "),
            run("x_from_other_mask03_lr", None),
        ],
        schemas.RUNS,
    )
    out = R.flatten_runs(df).select(*C.FINGERPRINT)
    got = [(r["experiment_class"], r["protocol"], r["phase"], r["source_dataset"], r["upstream_pretrain_lr"], r["upstream_pretrain_mask_ratio"]) for r in out.collect()]
    assert got == [
        ("k", "linear_probe", "p", "miiv", 0.0005, None), (None, "full_finetune", "baseline", "eicu", None, 0.75),
        (None, "linear_probe", "finetune", "combined", None, None), (None, None, "finetune", None, None, None),
    ]
    assert plan(out).count("StartsWith(") == 3
