from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortspark import schemas
from cohortspark.config import TaskConfig
from cohortspark.operators import gates, stages
from cohortspark.plans import build, prepare, report
from cohortspark.sources import sinks
from cohortspark.sources import tables as TB
from tests.test_results import BASE, run

LOS = TaskConfig("los_remaining", "los", task_type="regression", observation_hours=6)
DEATH = TaskConfig("mortality", "mortality", sources=("stays", "mortality_info"))
AKI = TaskConfig("aki_kdigo", "aki", observation_hours=6, prediction_hours=6, sources=("stays", "timeseries"),
                 params={"baseline_window_hours": 6})


def export(spark, folder, n=30):
    t0 = datetime(2024, 1, 1)
    stays = [(i, str(i // 2), t0, t0 + timedelta(days=4), 4.0 if i else 0.2, 40.0 + i, "F") for i in range(n)]
    spark.createDataFrame(stays, "stay_id bigint, patient_id string, intime timestamp, outtime timestamp, los_days double, age double, gender string") \
        .write.mode("overwrite").parquet(f"{folder}/stays")
    rows = [(i, h, float(h + i) if h % 2 == 0 else None, 1.0 + (h > 6) * (i % 3), float(h)) for i in range(n) for h in range(12) if i != 5]
    df = spark.createDataFrame(rows, "stay_id bigint, hour int, hr double, crea double, sofa double")
    for f in ("hr", "crea", "sofa"):
        df = df.withColumn(f"{f}_mask", F.col(f).isNotNull())
    df.write.mode("overwrite").parquet(f"{folder}/timeseries")
    spark.createDataFrame([(i, i % 2) for i in range(n)], "stay_id bigint, hospital_expire_flag int").write.mode("overwrite").parquet(f"{folder}/mortality")
    return TB.HourlyExport(spark, folder, "miiv")


def test_build_and_prepare(spark, folder):
    src = export(spark, f"{folder}/in")
    tasks = [LOS, DEATH, AKI]
    args = dict(signature="s", length=6, min_stay_hours=24)
    assert build.build_dataset(spark, src, tasks, f"{folder}/out", **args) == "rebuilt"
    assert build.build_dataset(spark, src, tasks, f"{folder}/out", **args) in ("unchanged", "appended")
    data = TB.load_dataset(spark, f"{folder}/out")
    ids = {r["stay_id"] for r in data["static"].collect()}
    assert ids == set(range(30)) - {0, 5}  # too short; never observed
    assert data["timeseries"].count() == data["labels"].count() == 28
    meta = data["metadata"].first()
    assert meta["feature_names"] == ["hr", "crea"] and meta["n_stays"] == 28  # the blocked score is gone
    lab = {r["stay_id"]: r for r in data["labels"].collect()}
    assert lab[3]["mortality"] == 1 and lab[4]["mortality"] == 0 and lab[4]["los_remaining"] == 3.75
    assert lab[3]["aki_kdigo"] == 0 and lab[4]["aki_kdigo"] == 1
    tables = {k: data[k] for k in sinks.TABLES}
    prep = prepare.prepare(spark, tables, ["hr", "crea"], f"{folder}/prep", seed=1)
    again = prepare.prepare(spark, tables, ["hr", "crea"], f"{folder}/prep", seed=1)
    assert sorted(prep["assigned"].collect()) == sorted(again["assigned"].collect())
    per = prep["assigned"].groupBy("patient_id").agg(F.count_distinct("split").alias("k"))
    assert per.filter("k > 1").count() == 0
    out = prepare.samples(tables, prep, "mortality", fraction=0.5)
    train = prep["assigned"].filter("split = 'train'").count()
    assert out.filter("split = 'train'").count() == max(1, int(train * 0.5))
    assert "los_days" not in out.columns
    means = prepare.samples(tables, prep, "mortality").filter("split = 'train'").select(
        F.explode("timeseries").alias("r")).agg(F.avg(F.col("r")[0]).alias("m")).first()["m"]
    assert abs(means) < 1e-9  # z-scores with zeros for the gaps
    win = prepare.samples(tables, prep, "mortality", window=3, train_stride=1)
    assert win.filter("split = 'test' and size(timeseries) <> 6").count() == 0
    assert win.filter("split = 'val'").select("window_start").distinct().count() == 2


def test_short_export_is_refused(spark, folder):
    src = export(spark, f"{folder}/in")
    longer = TaskConfig("aki_long", "aki", observation_hours=6, prediction_hours=24, sources=("stays", "timeseries"))
    with pytest.raises(gates.GateError, match="too short"):
        build.build_dataset(spark, src, [longer], f"{folder}/out", signature="s", length=6)
    with pytest.raises(gates.GateError, match="too short"):
        build.build_dataset(spark, src, [longer], f"{folder}/out", signature="s", length=6, exported_hours=12)


def test_result_tables(spark, folder):
    runs = []
    for i, (p, s) in enumerate([(p, s) for p in ("mae", "jepa") for s in (42, 123, 456)]):
        runs.append(run(i, {**BASE, "paradigm": p, "seed": s}, summary={"test/auprc": str(0.5 + 0.01 * i), "train/loss": "1"}))
    df = spark.createDataFrame(runs, schemas.RUNS)
    marts, warnings = report.result_tables(df)
    got = {r["check"]: r["n"] for r in warnings.collect()}
    assert got["seed_set"] == 2 and got["fairness_missing"] == 6 and got["checkpoint"] == 6 and "metric_gaps" not in got
    with pytest.raises(gates.GateError):
        sinks.write_marts(marts, f"{folder}/m", warnings)
    sinks.write_marts(marts, f"{folder}/m", warnings, allow_incomplete=True)
    agg = spark.read.parquet(f"{folder}/m/aggregated")
    assert agg.count() == 2 and agg.agg(F.min("n_seeds").alias("n")).first()["n"] == 3
    test = spark.read.parquet(f"{folder}/m/statistical_tests").first()
    assert test["n_pairs"] == 3 and test["p_value"] == 0.25
    with pytest.raises(gates.GateError, match="without an experiment class"):
        report.result_tables(spark.createDataFrame([run(1, {})], schemas.RUNS))


def test_stage_helpers(spark):
    raw = spark.createDataFrame([(1, datetime(2024, 1, 1), "a", 1.0), (1, datetime(2024, 1, 1, 6), "b", float("nan"))],
                                "stay_id bigint, charttime timestamp, feature_name string, valuenum double")
    r = stages.raw_summary(raw).first()
    assert (r["n_features"], r["span_hours"], r["max_value"], r["n_missing"]) == (2, 6.0, 1.0, 1)
    lab = spark.createDataFrame([(1, 1, "x"), (2, None, "y")], "stay_id bigint, t int, note string")
    s = stages.label_snapshot(lab).collect()
    assert len(s) == 1 and (s[0]["mean"], s[0]["sum"], s[0]["n_null"]) == (1.0, 1.0, 1)


def test_hot_keys_leave_the_shuffle(spark, monkeypatch):
    from cohortspark.operators import splits

    monkeypatch.setattr(splits, "MANY_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"p{i}") for i in range(300)] + [(999, None)], "stay_id bigint, patient_id string")
    table = rows.filter("patient_id is not null").select("patient_id").distinct().withColumn("split", F.concat(F.lit("s"), "patient_id"))
    out = splits.skew_safe_lookup(rows, table, "patient_id")
    assert out.count() == 301 and out.filter("split <> concat('s', patient_id)").count() == 0
    assert out.filter("split is null").count() == 1
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


class CountedExport:
    """An export that counts the rows read from its series."""

    def __init__(self, spark, inner):
        self.inner, self.name, self.rows = inner, inner.name, spark.sparkContext.accumulator(0)

    def stays(self):
        return self.inner.stays()

    def source(self, name):
        df = self.inner.source(name)
        if name != "timeseries":
            return df
        rows = self.rows

        def count(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)


def test_a_build_reads_its_series_once_and_counts_while_it_writes(spark, folder):
    src = CountedExport(spark, export(spark, f"{folder}/in"))
    tasks = [LOS, AKI]
    stays = src.stays()
    src.inner.stays = lambda: stays.filter("stay_id < 20")
    args = dict(signature="s", length=6, min_stay_hours=24)
    assert build.build_dataset(spark, src, tasks, f"{folder}/out", **args) == "rebuilt"
    n = src.inner.source("timeseries").count()
    assert n <= src.rows.value <= n + 200  # once, and a look at the first rows

    def held():
        meta = spark.read.json(f"{folder}/out/metadata").first()
        labels = spark.read.parquet(f"{folder}/out/labels")
        assert meta.n_stays == spark.read.parquet(f"{folder}/out/static").count() == labels.count() and meta.zero_observation_stays_excluded
        assert {r.task: r.non_null for r in meta.labels} == {t: labels.filter(F.col(t).isNotNull()).count() for t in ("los_remaining", "aki_kdigo")}
        return meta.n_stays

    assert held() == 18
    src.inner.stays = lambda: stays
    assert build.build_dataset(spark, src, tasks, f"{folder}/out", **args) == "appended" and held() == 28
    far = TaskConfig("aki_kdigo", "aki", observation_hours=60, prediction_hours=60, sources=("stays", "timeseries"))
    with pytest.raises(gates.GateError, match="too short"):
        build.build_dataset(spark, src, [far], f"{folder}/far", **args)
    assert not TB.path_exists(spark, f"{folder}/far/static")
