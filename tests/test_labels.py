import random

import pytest
from pyspark.sql import functions as F

from cohortspark.config import TaskConfig
from cohortspark.operators import labels as L

TASK = TaskConfig(
    "aki_kdigo", "aki", observation_hours=48, prediction_hours=24, sources=("stays", "timeseries"),
    params={"baseline_window_hours": 48},
)


def aki(spark, rows, task=TASK):
    ids = sorted({r[0] for r in rows}) or [1]
    stays = spark.createDataFrame([(i,) for i in ids], "stay_id bigint")
    series = spark.createDataFrame([r for r in rows if r[1] is not None], "stay_id bigint, hour int, crea double")
    out = L.aki_with_reasons(task, {"stays": stays, "timeseries": series}).collect()
    return {r["stay_id"]: (r["label"], r["null_reason"]) for r in out}


def test_rise_cases(spark):
    rows = [
        (1, 10, 1.0), (1, 50, 1.1),                       # stable
        (2, 10, 1.0), (2, 50, 1.3),                       # absolute, exactly met
        (3, 10, 0.5), (3, 60, 0.75),                       # relative, exactly met
        (4, 2, 1.0), (4, 30, 2.0), (4, 50, 1.0),          # rise inside the observation only
        (5, None, None),                                  # no data
        (6, 50, 1.0),                                     # no baseline
        (7, 10, 1.0),                                     # no later value
        (8, 1, 1.0), (8, 50, 1.35), (8, 47, 1.30),        # pair 49 h apart is too far, 3 h apart too small
    ]
    got = aki(spark, rows)
    assert got[1] == (0, None) and got[2][0] == 1 and got[3][0] == 1 and got[4][0] == 0
    assert got[5] == (None, "no_creatinine_or_baseline") == got[6]
    assert got[7] == (None, "no_post_obs_creatinine")
    assert got[8][0] == 0


def test_rise_equals_pairwise_test(spark):
    rnd = random.Random(4)
    rows = [(s, rnd.randrange(72), round(rnd.uniform(0.5, 2.0), 2)) for s in range(40) for _ in range(6)]

    def brute(mine):
        base = [v for _, h, v in mine if h < 48]
        late = [(h, v) for _, h, v in mine if 48 <= h < 72]
        if not base or not late:
            return None
        rel = any(v >= min(base) * 1.5 for _, v in late)
        rise = any(0 < hj - hi <= 48 and vj - vi >= 0.3 for hj, vj in late for _, hi, vi in mine)
        return int(rel or rise)

    got = aki(spark, rows)
    for s in range(40):
        assert got[s][0] == brute([r for r in rows if r[0] == s])


def test_missing_value_column_gives_null_labels(spark):
    stays = spark.createDataFrame([(1,)], "stay_id bigint")
    series = spark.createDataFrame([(1, 0)], "stay_id bigint, hour int")
    assert L.build_aki(TASK, {"stays": stays, "timeseries": series}).first()["label"] is None


def test_no_prediction_window_is_an_error(spark):
    with pytest.raises(ValueError):
        aki(spark, [(1, 1, 1.0)], TaskConfig("aki", "aki", observation_hours=24))


def test_remaining_los(spark):
    stays = spark.createDataFrame([(1, 3.5), (2, 1.0), (3, 0.5), (4, None)], "stay_id bigint, los_days double")
    t = TaskConfig("los", "los", observation_hours=24)
    got = {r["stay_id"]: r["label"] for r in L.build_los(t, {"stays": stays}).collect()}
    assert got == {1: 2.5, 2: 0.0, 3: 0.0, 4: None}
    free = TaskConfig("los", "los")
    assert L.build_los(free, {"stays": stays}).filter("stay_id = 1").first()["label"] == 3.5


def test_registry_prefix_and_sources(spark):
    L.register_label("custom", lambda task, src: src["stays"].select("stay_id", F.lit(7).alias("label")))
    try:
        task = TaskConfig("custom_task", "other")
        stays = spark.createDataFrame([(1,)], "stay_id bigint")
        out = L.extract_labels([task], {"stays": stays})
        assert out.first()["custom_task"] == 7
        with pytest.raises(ValueError, match="needs sources"):
            L.extract_labels([TaskConfig("custom_x", "other", sources=("gone",))], {"stays": stays})
        with pytest.raises(ValueError, match="observes"):
            L.extract_labels([TaskConfig("custom_y", "other", observation_hours=12)], {"stays": stays}, seq_length=24)
        skipped = L.extract_labels([TaskConfig("custom_z", "other", datasets=("miiv",))], {"stays": stays}, "eicu")
        assert skipped.columns == ["stay_id"]
    finally:
        del L.BUILDERS["custom"]
    with pytest.raises(ValueError, match="no label builder"):
        L.builder_for(TaskConfig("zzz", "zzz"))


def test_numeric_summary_and_types(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 7.0, None), (4, None, 2)], "stay_id int, label double, c int")
    s = L.numeric_summary(df).first()
    assert (s["mean"], s["median"], s["q25"], s["n"]) == (3.3333, 2.0, 1.5, 3)
    one = L.numeric_summary(df.limit(1)).first()
    assert one["std"] == 0.0
    kinds = {r["task"]: r["task_type"] for r in L.infer_task_type(
        df.withColumns({"b": F.lit(1), "e": F.lit(None).cast("int"), "r": F.rand(1)}), ["c", "b", "e", "r"]).collect()}
    assert kinds == {"c": "multiclass", "b": "binary", "e": "unknown", "r": "regression"}


def test_config_hash_ignores_quality_limits():
    a, b = TaskConfig("t", "los"), TaskConfig("t", "los", max_missing_pct=5.0)
    assert a.config_hash() == b.config_hash() != TaskConfig("t", "los", observation_hours=24).config_hash()
