"""Datasets that must not be combined, and stored metadata that do not fit their tables."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import combine as U
from cohortspark.operators import gates as G

TASKS = ("t1", "t2")


def side(spark, first, **changes):
    meta = {"feature_names": ["hr", "map"], "tasks": list(TASKS), "feature_set": "core", "seq_length_hours": 48, "min_stay_hours": 48, "label_horizon_hours": 168}
    meta |= {k: v for k, v in changes.items() if k in meta}
    manifest = changes.get("manifest", [("t1", "1", "aa"), ("t2", "1", "bb")])
    labels = spark.createDataFrame([(first, 0, 1)], "stay_id long, t1 int, t2 int").drop(*changes.get("no_labels", []))
    series = spark.createDataFrame([(first, [[1.0]])], f"stay_id long, timeseries array<array<{changes.get('kind', 'double')}>>")
    return {
        "static": spark.createDataFrame([(first, "10")], "stay_id long, patient_id string"), "timeseries": series, "labels": labels,
        "metadata": spark.createDataFrame([meta], "feature_names array<string>, tasks array<string>, feature_set string, seq_length_hours int, min_stay_hours int, label_horizon_hours int"),
        "manifest": spark.createDataFrame(manifest, "task string, builder_version string, config_hash string"),
    }


def test_matching_sides_are_combined(spark):
    out = U.combine_checked(side(spark, 1), side(spark, 1), ("a", "b"), TASKS)
    assert sorted((r.stay_id, r.patient_id) for r in out["static"].collect()) == [(1, "a:10"), (1 + U.ID_OFFSET, "b:10")]
    assert out["manifest"].count() == 2 and out["labels"].count() == 2


@pytest.mark.parametrize("changes, check", [
    ({"feature_names": ["map", "hr"]}, "feature_order"), ({"feature_names": ["hr"]}, "features"), ({"feature_names": None}, "features"),
    ({"seq_length_hours": 72}, "invariant"), ({"label_horizon_hours": None}, "invariant"), ({"tasks": ["t1"]}, "tasks"), ({"tasks": None}, "tasks"),
    ({"manifest": [("t1", "1", "aa")]}, "label_manifest"), ({"manifest": [("t1", "1", "aa"), ("t2", "2", "bb")]}, "manifest_entry"),
    ({"manifest": [("t1", "1", "aa"), ("t2", "1", None)]}, "manifest_entry"), ({"no_labels": ["t2"]}, "label_columns"), ({"kind": "float"}, "series_schema"),
])
def test_each_difference_is_an_error(spark, changes, check):
    good, bad = side(spark, 1), side(spark, 2, **changes)
    found = [r.check for r in G.combine_findings(good, bad, ("a", "b"), TASKS).collect()]
    assert check in found
    with pytest.raises(G.GateError, match=check):
        U.combine_checked(good, bad, ("a", "b"), TASKS)


@pytest.mark.parametrize("lost", ["metadata", "manifest"])
def test_what_is_not_known_is_an_error(spark, lost):
    bad = side(spark, 2)
    del bad[lost]
    with pytest.raises(G.GateError, match="there is no"):
        U.combine_checked(side(spark, 1), bad, ("a", "b"), TASKS)


def test_readiness(spark):
    def found(dataset="miiv", rows=3, **meta):
        told = spark.createDataFrame([meta], ", ".join(f"{k} {v}" for k, v in kinds.items() if k in meta))
        tables = {t: spark.range(rows if t == "labels" else 3) for t in ("static", "timeseries", "labels")}
        return {(r.check, r.found, r.wanted) for r in G.readiness_findings(told, tables, dataset, 2).collect()}

    kinds = {"n_features": "int", "feature_names": "array<string>", "n_stays": "long", "zero_observation_stays_excluded": "boolean"}
    assert found(n_features=2, n_stays=3, zero_observation_stays_excluded=True) == set()
    assert found(feature_names=["a", "b"], zero_observation_stays_excluded=True) == set()  # no count of stays to hold against
    assert found(n_features=3, n_stays=3) == {("n_features", 3, 2), ("zero_observation_stays_excluded", 0, 1)}
    assert found("combined", 2, n_features=2, n_stays=3) == {("labels_rows", 2, 3)}
    empty = spark.createDataFrame([], "n_features int, n_stays long")
    assert ("metadata", 0, 1) in {tuple(r) for r in G.readiness_findings(empty, {"static": spark.range(1).select(F.col("id"))}, "miiv").collect()}
