import pytest
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.config import ConceptRule, Criterion, Slot
from cohortspark.functions import values as V
from cohortspark.operators import cohort as CO
from cohortspark.operators import events as EV
from cohortspark.operators import splits as S


def test_blocklist_size():
    assert (len(C.LEAKING_FEATURES), len(C.FUTURE_FEATURES), len(C.SUMMARY_FEATURES)) == (3, 13, 15)


def test_binning_aggregations(spark):
    rows = [(1, 0, "a", 2.0, 1, 1), (1, 0, "a", 4.0, 2, 2), (1, 0, "b", 0.0, 1, 3), (1, 0, "c", 5.0, 2, 4),
            (1, 0, "c", 7.0, 1, 5), (1, 1, "d", 1.0, 1, 6), (1, 1, "d", 2.0, 1, 7), (1, 99, "a", 1.0, 1, 8)]
    df = spark.createDataFrame(rows, "stay_id bigint, hour int, feature string, value double, ts int, event_id int")
    rules = [ConceptRule("a", "mean"), ConceptRule("b", "any"), ConceptRule("c", "last"), ConceptRule("d", "sum")]
    got = {r["hour"]: r.asDict() for r in EV.hourly_bins(df, rules, max_hour=24).collect()}
    assert got[0] == {"stay_id": 1, "hour": 0, "a": 3.0, "a_mask": True, "b": 0.0, "b_mask": True, "c": 5.0,
                      "c_mask": True, "d": None, "d_mask": False}
    assert got[1]["d"] == 3.0 and set(got) == {0, 1}
    first = EV.hourly_bins(df, [ConceptRule("c", "first")]).filter("hour = 0").first()
    assert first["c"] == 7.0


def test_rule_kinds_and_ranges(spark):
    raw = spark.createDataFrame([(1, 5, "Heart Rate", 400.0, None), (2, 9, "temp F", 212.0, 3.0)],
                                "event_id int, item_id int, label string, value double, extra double")
    rules = [ConceptRule("hr", kind="string", match=("Heart Rate",), hi=300.0),
             ConceptRule("temp", kind="regex", match=("^temp",), transform="fahrenheit_to_celsius"),
             ConceptRule("item", kind="item", match=(5, 9)), ConceptRule("x", kind="column", match=("extra",))]
    got = {(r["event_id"], r["feature"]): r["value"] for r in EV.apply_concept_rules(raw, rules).collect()}
    assert got == {(1, "hr"): None, (1, "item"): 400.0, (2, "temp"): 100.0, (2, "item"): 212.0, (2, "x"): 3.0}
    with pytest.raises(ValueError):
        ConceptRule("a", "median")


def test_keep_last_and_gap_filling(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 0, None, 2)], "stay_id bigint, hour int, x double, k int")
    assert EV.keep_last(df, ["stay_id", "hour"], ["k"]).first()["x"] is None
    binned = EV.with_masks(df.filter("k = 1").drop("k"), ["x"])
    stays = spark.createDataFrame([(1, 0.1), (2, 0.0), (3, 9.0)], "stay_id bigint, los_days double")
    full = EV.fill_stay_hours(binned, stays, ["x"], 5)
    assert {r["stay_id"]: r["n"] for r in full.groupBy("stay_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 3: 5}
    assert full.filter("x_mask is null").count() == 0


def test_predicates_and_tags(spark):
    with pytest.raises(ValueError):
        CO.predicate("a", "~", 1)
    with pytest.raises(ValueError):
        CO.predicate("a", "between", [1, 2])
    df = spark.createDataFrame([(None, ["paradigm:mae"]), ("mae", []), ("x", ["paradigm:mae"]), (None, None)],
                               "paradigm string, tags array<string>")
    assert df.filter(CO.run_matches("paradigm", "tags", "paradigm", ["mae"])).count() == 2
    assert df.filter(CO.run_matches("paradigm", "tags", "paradigm", [])).count() == 4


def test_missing_labels(spark):
    df = spark.createDataFrame([(1, 1, 0, None), (2, None, 1, 1)], "stay_id bigint, t int, m_a int, m_b int")
    assert [r["stay_id"] for r in CO.labelled_stays(df, "t").collect()] == [1]
    assert [r["stay_id"] for r in CO.labelled_stays(df, "m").collect()] == [2]
    assert CO.removed_samples(df, "t").first().asDict() == {"stay_id": 2, "reason": "missing_t_label"}
    with pytest.raises(ValueError):
        CO.labelled_stays(df, "t", "raise")
    with pytest.raises(ValueError):
        CO.labelled_stays(df, "zz")


def test_slots_never_repeat_and_fall_back(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "stay_id bigint, los_days double")
    slots = tuple(Slot(f"s{i}", (("los_days", "<", 4),), "los_days") for i in range(4)) + (Slot("rest"),)
    got = {r["slot_name"]: r["stay_id"] for r in CO.select_slots(df, slots).collect()}
    assert (got["s0"], got["s1"], got["s2"]) == (1, 2, 3) and "s3" not in got and got["rest"] in (4, 5)
    none = CO.select_slots(df, (Slot("x", (("los_days", ">", 99),)),)).collect()
    assert len(none) == 5 and {r["slot_name"] for r in none} == {"fallback"}


def test_strata(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "stay_id bigint, y int")
    out = CO.stratified_sample(df, [Criterion("y", values=(0, 1))], 3)
    assert {r["slot_name"]: r["n"] for r in out.groupBy("slot_name").agg(F.count("*").alias("n")).collect()} == {"0": 3, "1": 3}
    assert CO.stratified_sample(df, [Criterion("zz", values=(1,))], 1).count() == 8


def test_people(spark):
    g = ["m", " Female ", "unknown", "N/A", "Other", "", None]
    df = spark.createDataFrame([(x,) for x in g], "g string")
    assert [r[0] for r in df.select(V.gender_group("g")).collect()] == ["M", "F", None, None, "Other", None, None]
    assert [r[0] for r in df.select(V.strict_gender("g")).collect()] == ["M", None, None, None, None, None, None]
    races = ["HISPANIC/LATINO - CUBAN", "black_african", "WHITE", "ASIAN", "PATIENT REFUSED", "NATIVE", " ", "UNABLE TO OBTAIN", "WHITE/HISPANIC"]
    r = spark.createDataFrame([(x,) for x in races], "race string")
    assert [x[0] for x in r.select(V.race_group("race")).collect()] == [
        "Hispanic", "Black", "White", "Asian", None, "Other", None, None, "Hispanic"]
    src = spark.createDataFrame([("WHITE", "MIMIC-IV"), ("WHITE", "eicu"), ("WHITE", None)], "race string, s string")
    assert [x[0] for x in src.select(V.race_group("race", "s")).collect()] == ["White", None, "White"]
    assert [x[0] for x in src.select(V.race_group("race", "s", "combined")).collect()] == ["White", None, None]
    ages = spark.createDataFrame([(x,) for x in (17.9, 18.0, 44.5, 64.0, 80.0, float("nan"), None, float("inf"))], "a double")
    assert [x[0] for x in ages.select(V.age_group("a")).collect()] == [None, "18-44", None, "45-64", "80+", None, None, None]


def test_split_counts_and_determinism(spark):
    stays = spark.createDataFrame([(i, f"p{i % 41}") for i in range(200)], "stay_id bigint, patient_id string")
    a = S.split_patients(stays, 1).collect()
    b = S.split_patients(stays.repartition(5), 1).collect()
    assert sorted(a) == sorted(b)
    n = {s: sum(r["split"] == s for r in a) for s in ("train", "val", "test")}
    assert n == {"train": int(41 * 0.7), "val": int(41 * 0.15), "test": 41 - int(41 * 0.7) - int(41 * 0.15)}
    with pytest.raises(ValueError):
        S.split_patients(stays, ratios=(0.5, 0.2, 0.2))
    with pytest.raises(Exception, match="no split for patient"):
        S.assign_split(stays, S.split_patients(stays.filter("patient_id <> 'p3'"))).collect()


def test_label_fraction_size(spark):
    stays = spark.range(10).withColumnRenamed("id", "stay_id")
    assert S.label_fraction(stays, 0.01).filter("in_subset").count() == 1
    assert S.label_fraction(stays, 0.55).filter("in_subset").count() == 5
    with pytest.raises(ValueError):
        S.label_fraction(stays, 0.0)


def test_split_reuse(spark, folder):
    stays = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "stay_id bigint, patient_id string")
    path = f"{folder}/split"
    split = S.reuse_or_split(spark, path, stays, 3)
    S.split_record(S.assign_split(stays, split), 3).write.parquet(path)
    again = S.reuse_or_split(spark, path, stays, 3)
    assert sorted(again.collect()) == sorted(split.collect())
    assert not S.cached_split_check(spark.read.parquet(path), stays, 4).first()["reusable"]
    more = stays.unionByName(spark.createDataFrame([(99, "new")], stays.schema))
    assert S.cached_split_check(spark.read.parquet(path), more, 3).first()["n_unsplit_patients"] == 1


def test_durations_and_codes(spark):
    df = spark.sql("select interval '1 06:30:00' day to second as d, 'V' as avpu, true as avpu_mask, 'zz' as mech_vent, true as mech_vent_mask")
    r = V.encode_categories(V.intervals_to_hours(df)).first()
    assert r["d"] == 30.5 and r["avpu"] == 1.0 and r["avpu_mask"] and r["mech_vent"] is None and not r["mech_vent_mask"]
