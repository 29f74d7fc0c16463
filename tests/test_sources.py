import gzip
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import schemas
from cohortspark.sources import hospital as H
from cohortspark.sources import sinks as SK
from cohortspark.sources import tables as TB

EPOCH = datetime(2000, 1, 1)


def test_parquet_file_folder_and_missing(spark, folder):
    spark.range(10).withColumnRenamed("id", "stay_id").repartition(3).write.parquet(f"{folder}/t")
    assert TB.read_parquet(spark, f"{folder}/t").count() == 10
    part = next(f for f in os.listdir(f"{folder}/t") if f.endswith(".parquet"))
    assert TB.read_parquet(spark, f"{folder}/t/{part}", columns=["stay_id"]).columns == ["stay_id"]
    with pytest.raises(FileNotFoundError):
        TB.read_parquet(spark, f"{folder}/none")


def test_key_filter_literals_reach_the_scan(spark, folder):
    spark.range(100).withColumnRenamed("id", "stay_id").write.parquet(f"{folder}/t")
    df = TB.read_parquet(spark, f"{folder}/t")
    few = TB.key_filter(df, [1, 2, 3])
    assert few.count() == 3
    assert "PushedFilters: [In(stay_id" in few._jdf.queryExecution().toString()
    assert TB.key_filter(df, range(5, 700)).count() == 95
    assert TB.key_filter(df, df.filter("stay_id > 97")).count() == 2


def test_raw_csv(spark, folder):
    os.makedirs(f"{folder}/hosp")
    with gzip.open(f"{folder}/hosp/patients.csv.gz", "wt") as f:
        f.write("subject_id,gender\n1,F\n2,M\n")
    schema = T.StructType([T.StructField("subject_id", T.LongType()), T.StructField("gender", T.StringType())])
    assert TB.read_raw_csv(spark, folder, "hosp", "patients", schema).count() == 2
    none = TB.read_raw_csv(spark, folder, "hosp", "gone", schema)
    assert none.count() == 0 and none.schema == schema


def export(spark, folder):
    spark.createDataFrame([(1,), (2,)], "stay_id bigint").write.parquet(f"{folder}/stays.parquet")
    spark.createDataFrame([(1, 0, "V", True), (2, 0, "Q", True)], "stay_id bigint, hour int, avpu string, avpu_mask boolean") \
        .write.parquet(f"{folder}/timeseries")
    spark.createDataFrame([(1, 0)], "stay_id bigint, hospital_expire_flag int").write.parquet(f"{folder}/mortality")
    spark.createDataFrame([(1, "A00", 10)], "stay_id bigint, icd_code string, icd_version int").write.parquet(f"{folder}/diagnoses")
    return TB.HourlyExport(spark, folder, "miiv")


def test_hourly_export(spark, folder):
    e = export(spark, folder)
    got = {r["stay_id"]: (r["avpu"], r["avpu_mask"]) for r in e.timeseries().collect()}
    assert got == {1: (1.0, True), 2: (None, False)}
    assert e.source("timeseries", [2]).count() == 1 and e.source("diagnoses").count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        e.source("nothing")
    assert e.metadata() == {}


def test_signature_follows_the_files(spark, folder):
    spark.range(5).write.parquet(f"{folder}/t")
    a = TB.input_signature(spark, [f"{folder}/t"], TB.default_signature_settings())
    assert a == TB.input_signature(spark, [f"{folder}/t"], TB.default_signature_settings())
    assert a != TB.input_signature(spark, [f"{folder}/t"], ["other"])
    spark.range(6).write.mode("append").parquet(f"{folder}/t")
    assert a != TB.input_signature(spark, [f"{folder}/t"], TB.default_signature_settings())


def test_signature_follows_files_without_a_suffix(spark, folder):
    import shutil
    from pathlib import Path

    spark.range(5).coalesce(1).write.parquet(f"{folder}/t")
    part = next(Path(f"{folder}/t").glob("*.parquet"))
    a = TB.input_signature(spark, [f"{folder}/t"])
    for name in ("_metadata", "_old", ".part-1"):
        shutil.copy(part, f"{folder}/t/{name}")
    assert a == TB.input_signature(spark, [f"{folder}/t"]) and TB.input_files(spark, f"{folder}/t").count() == 1
    shutil.copy(part, f"{folder}/t/part-00001")
    assert spark.read.parquet(f"{folder}/t").count() == 10 and TB.input_files(spark, f"{folder}/t").count() == 2
    assert a != TB.input_signature(spark, [f"{folder}/t"])
    shutil.copy(part, f"{folder}/part-single")
    assert TB.input_files(spark, f"{folder}/part-single").count() == 1


def dataset(spark, stays):
    ts = stays.select("stay_id", F.array(F.array(F.lit(1.0))).alias("timeseries"), F.array(F.array(F.lit(True))).alias("mask"))
    return {"static": stays, "timeseries": ts, "labels": stays.select("stay_id", F.lit(1).alias("t"))}


def test_resume(spark, folder):
    path, settings = f"{folder}/out", {"seq_length_hours": 24, "tasks_wanted": ["t"]}
    two = spark.createDataFrame([(1,), (2,)], "stay_id bigint")
    three = spark.createDataFrame([(1,), (2,), (3,)], "stay_id bigint")

    def run(stays, **kw):
        args = {"settings": settings, "signature": "s1", **kw}
        return SK.append_or_rebuild(spark, path, stays, lambda s: dataset(spark, s), features=["x"], **args)

    assert run(two) == "rebuilt" and run(two) == "unchanged" and run(three) == "appended"
    loaded = TB.load_dataset(spark, path)
    assert sorted(r["stay_id"] for r in loaded["labels"].collect()) == [1, 2, 3]
    meta = loaded["metadata"].first()
    assert meta["n_stays"] == 3 and meta["feature_names"] == ["x"] and meta["labels"][0]["non_null"] == 3
    # a run that died after its first append: the next one adds no row twice
    four = spark.createDataFrame([(1,), (2,), (3,), (4,)], "stay_id bigint")
    series = dataset(spark, four.filter("stay_id = 4"))["timeseries"]
    n = series.count()
    series.write.mode("append").parquet(f"{path}/timeseries")
    assert run(four) == "appended" and run(four) == "unchanged"
    loaded = TB.load_dataset(spark, path)
    assert loaded["timeseries"].filter("stay_id = 4").count() == n > 0
    assert sorted(r["stay_id"] for r in loaded["static"].collect()) == [1, 2, 3, 4]
    assert run(two, signature="s2") == "rebuilt"
    assert TB.load_dataset(spark, path)["static"].count() == 2


def test_snapshot_hourly_and_vectors(spark, folder):
    tables = dataset(spark, spark.createDataFrame([(1,), (2,)], "stay_id bigint"))
    SK.write_snapshot(tables, tables["static"].filter("stay_id = 2"), ["x"], f"{folder}/snap")
    rows = spark.read.option("header", True).csv(f"{folder}/snap/timeseries").collect()
    assert [r["feature_name"] for r in rows] == ["x"]
    hourly = spark.createDataFrame([(1, h, 1.0) for h in range(50)], "stay_id bigint, hour int, x double")
    SK.write_hourly(hourly, f"{folder}/h", parts=3)
    assert spark.read.parquet(f"{folder}/h").count() == 50
    SK.write_embeddings(spark.createDataFrame([(7, [1.0, 2.0])], "k bigint, embedding array<double>"), f"{folder}/e", "k")
    assert TB.read_embeddings(spark, f"{folder}/e").first()["embedding"] == [1.0, 2.0]


def test_marts_are_complete_and_gated(spark, folder):
    one = spark.range(1)
    with pytest.raises(ValueError, match="missing"):
        SK.write_marts({"per_seed": one}, folder)
    marts = {n: one for n in SK.MART_TABLES}
    with pytest.raises(ValueError, match="validation"):
        SK.write_marts(marts, f"{folder}/m", one)
    SK.write_marts(marts, f"{folder}/m", one, allow_incomplete=True)
    assert len(os.listdir(f"{folder}/m")) == 9


# --- hospital adapters ---------------------------------------------------------------------

def test_icu_family(spark):
    icu = spark.createDataFrame([(1, 10, 100, EPOCH, EPOCH, "MICU"), (2, 11, 101, EPOCH, EPOCH, "CCU"), (3, 12, 102, None, None, None)],
                                "icustay_id bigint, subject_id bigint, hadm_id bigint, intime timestamp, outtime timestamp, first_careunit string")
    adm = spark.createDataFrame([(100, "WHITE", "EMERGENCY", 1, datetime(2024, 1, 5, 3)), (101, "ASIAN", "URGENT", 0, None)],
                                "hadm_id bigint, ethnicity string, admission_type string, hospital_expire_flag int, deathtime timestamp")
    pat = spark.createDataFrame([(10, datetime(2024, 1, 5)), (11, datetime(2024, 2, 1)), (12, None)], "subject_id bigint, dod timestamp")
    tables = {"icustays": icu, "admissions": adm, "patients": pat}
    win = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 1.0)], "stay_id bigint, los_days double")
    demo = spark.createDataFrame([(1, "female", 40.0), (2, "X", 50.0)], "stay_id bigint, sex string, age double")
    stays = {r["stay_id"]: r for r in H.build_stays(win, demo, H.admin_rows("mimic", tables)).collect()}
    assert H.build_stays(win, demo, None).columns == [f.name for f in schemas.STAYS.fields]
    assert (stays[1]["gender"], stays[2]["gender"], stays[1]["race"], stays[3]["race"]) == ("F", None, "WHITE", None)
    info = {r["stay_id"]: r for r in H.build_mortality_info("mimic", tables, win).collect()}
    assert info[1]["death_time_precision"] == "timestamp" and info[1]["death_date"] is None
    assert info[2]["death_time_precision"] == "date" and info[2]["death_date"] == date(2024, 2, 1)
    assert info[2]["death_source"] == "patients.dod" and info[3]["death_time_precision"] is None
    diag = spark.createDataFrame([(100, "4280"), (100, "25000"), (999, "1")], "hadm_id bigint, icd9_code string")
    rows = H.build_diagnoses("mimic", {**tables, "diagnoses_icd": diag}).collect()
    assert sorted((r["stay_id"], r["icd_code"], r["icd_version"]) for r in rows) == [(1, "25000", 9), (1, "4280", 9)]


def test_offset_family(spark):
    cols = ("patientunitstayid bigint, uniquepid string, hospitaladmitoffset int, unitdischargeoffset int, hospitaldischargeoffset int, "
            "hospitaldischargestatus string, unitdischargestatus string, hospitaldischargelocation string, unitdischargelocation string")
    rows = [
        (1, "a", -5, 600, 900, "Expired", "Alive", "Death", "Floor"),
        (2, "b", -5, 600, 900, "Alive", "Alive", "Home", "Floor"),
        (3, "c", -5, 600, None, " ", "Expired", None, "Death"),
        (4, "d", -5, None, None, "NA", None, "", "Floor"),
        (5, "e", -5, None, None, "Expired", None, None, None),
    ]
    pat = spark.createDataFrame(rows, cols)
    info = {r["stay_id"]: r for r in H.build_mortality_info("eicu", {"patient": pat}, pat).collect()}
    assert info[1]["death_time"] == datetime(2000, 1, 1, 15) and info[1]["hospital_expire_flag"] == 1
    assert info[1]["discharge_location"] == "Death" and info[1]["death_source"] == "patient.hospitaldischargestatus"
    assert info[2]["hospital_expire_flag"] == 0 and info[2]["death_time"] is None and info[2]["dischtime"] == datetime(2000, 1, 1, 15)
    assert info[3]["death_time"] == datetime(2000, 1, 1, 10) and info[3]["death_source"] == "patient.unitdischargestatus"
    assert info[4]["hospital_expire_flag"] is None and info[4]["discharge_location"] == "Floor"
    assert info[5]["death_time_precision"] == "unknown" and info[5]["death_time"] is None
    admin = {r["stay_id"]: r for r in H.admin_rows("eicu", {"patient": pat}).collect()}
    assert admin[1]["intime"] == EPOCH and admin[1]["outtime"] == datetime(2000, 1, 1, 10) and admin[4]["outtime"] is None
    diag = spark.createDataFrame([(1, "428.0, I50.9,"), (2, " "), (3, None)], "patientunitstayid bigint, icd9code string")
    got = H.build_diagnoses("eicu", {"diagnosis": diag}).collect()
    assert sorted(r["icd_code"] for r in got) == ["428.0", "I50.9"] and {r["icd_version"] for r in got} == {9}


def test_other_families(spark):
    hirid = spark.createDataFrame([(5, EPOCH)], "patientid bigint, admissiontime timestamp")
    r = H.admin_rows("hirid", {"general": hirid}).first()
    assert (r["stay_id"], r["patient_id"], r["outtime"]) == (5, "5", None)
    aumc = spark.createDataFrame([(7, 70, EPOCH, EPOCH)], "admissionid bigint, patientid bigint, admittedat timestamp, dischargedat timestamp")
    assert H.admin_rows("aumc", {"admissions": aumc}).first()["patient_id"] == "70"
    sic = spark.createDataFrame([(9,)], "CaseID bigint")
    assert H.admin_rows("sic", {"cases": sic}).first()["stay_id"] == 9
    assert H.admin_rows("aumc", {}) is None and H.admin_rows("nope", {}) is None
    stays = spark.createDataFrame([(1,)], "stay_id bigint")
    assert H.build_mortality_info("hirid", {}, stays).first()["hospital_expire_flag"] is None
    flags = spark.createDataFrame([(1, True)], "stay_id bigint, death boolean")
    assert H.build_mortality_info("hirid", {}, stays, flags).first()["hospital_expire_flag"] == 1
    assert H.build_diagnoses("hirid", {}) is None
