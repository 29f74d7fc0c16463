"""Registered queries: what readers, writers and adapters give back, on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.config import TaskConfig
from cohortspark.operators import cohort as CO
from cohortspark.operators import grid as GR
from cohortspark.operators import normalize as N
from cohortspark.operators import stages as SA
from cohortspark.plans import analogs as A
from cohortspark.plans import build as B
from cohortspark.plans.queries_cohort import _LAB, all_labels, r6, split_stays
from cohortspark.plans.queries_series import _C, _G, _N, FE, T, grid
from cohortspark.plans.registry import query
from cohortspark.plans.registry import with_tables as W
from cohortspark.session import new_folder, stage
from cohortspark.sources import hospital as HO
from cohortspark.sources import sinks
from cohortspark.sources import tables as TB


@query("hourly_files", W("ev cleaned hourly", """
SELECT stay_id, hour, round(click, 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase, signup, round(view, 6) AS view FROM hourly"""))
def hourly_files(spark, sf):
    """Part files by stay, read back through the export."""
    path = new_folder(spark, "hourly")
    sinks.write_hourly(A.hourly(spark, sf), f"{path}/timeseries")
    rows = TB.HourlyExport(spark, path, "miiv").source("timeseries")
    return r6(rows.select("stay_id", "hour", *FE), "click", "error", "purchase", "view")


@query("embedding_files", """
SELECT vec_id AS id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4) AS total FROM embeddings""")
def embedding_files(spark, sf):
    path = new_folder(spark, "vectors")
    sinks.write_embeddings(A.table(spark, sf, "embeddings"), path, "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return TB.read_embeddings(spark, path).select("id", F.size("embedding").cast("bigint").alias("width"), F.round(total, 4).alias("total"))


@query("snapshot_files", W(_C, """
SELECT stay_id, hour, feature_name, round(value, 6) AS value, observed FROM cell WHERE stay_id IN (SELECT stay_id FROM stays WHERE stay_id % 5 = 0)"""))
def snapshot_files(spark, sf):
    """The CSV snapshot of every fifth stay, read back."""
    stays = A.stays(spark, sf)
    dense = GR.dense_grid(A.hourly(spark, sf), stays, FE, T, unique=True)
    path = new_folder(spark, "snapshot")
    tables = {"static": stays.select("stay_id", "age"), "timeseries": dense, "labels": all_labels(spark, sf)}
    sinks.write_snapshot(tables, stays.filter("stay_id % 5 = 0").select("stay_id"), FE, path)
    kinds = "stay_id bigint, hour int, feature_name string, value double, observed boolean"
    return r6(spark.read.option("header", True).schema(kinds).csv(f"{path}/timeseries"), "value")


@query("raw_csv_tables", """
SELECT o_orderkey AS stay_id, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders""")
def raw_csv_tables(spark, sf):
    """A packed raw table and one that is not there, which reads as empty."""
    from pyspark.sql import types as ST

    root = new_folder(spark, "raw")
    rows = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stay_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    rows.write.option("header", True).option("compression", "gzip").csv(f"{root}/hosp/orders.csv.gz")
    schema = ST.StructType.fromDDL("stay_id bigint, status string, price double")
    there = TB.read_raw_csv(spark, root, "hosp", "orders", schema)
    return there.unionByName(TB.read_raw_csv(spark, root, "hosp", "absent", schema)).withColumn("price", F.round("price", 2))


@query("label_snapshot", W(_LAB, """
SELECT 'aki_kdigo' AS label_name, round(avg(aki_kdigo), 6) AS mean, round(sum(aki_kdigo), 6) AS sum, count(*) - count(aki_kdigo) AS n_null FROM labels3
UNION ALL SELECT 'los_remaining', round(avg(los_remaining), 6), round(sum(los_remaining), 6), count(*) - count(los_remaining) FROM labels3
UNION ALL SELECT 'mortality_hospital', round(avg(mortality_hospital), 6), round(sum(mortality_hospital), 6), count(*) - count(mortality_hospital) FROM labels3"""))
def label_snapshot(spark, sf):
    out = SA.label_snapshot(all_labels(spark, sf).select("stay_id", "aki_kdigo", "los_remaining", "mortality_hospital"))
    return r6(out, "mean", "sum")


@query("public_columns", "SELECT o_orderkey AS run_id, o_orderstatus AS state FROM orders")
def public_columns(spark, sf):
    runs = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"), F.to_json(F.struct("o_orderpriority")).alias("config_json"),
        F.create_map(F.lit("price"), F.col("o_totalprice")).alias("metrics"),
    )
    return CO.public_columns(runs)


_OFFSET = """CAST(floor(o_totalprice) AS BIGINT) % 9000 AS u, CAST(floor(o_totalprice) AS BIGINT) % 20000 AS h"""
@query("offset_stays", f"""
SELECT o_orderkey AS stay_id, CAST(o_custkey AS VARCHAR) AS patient_id, u * 60000000 AS after_epoch,
  o_orderpriority AS first_careunit FROM (SELECT *, {_OFFSET} FROM orders)""")
def offset_stays(spark, sf):
    """Administration by minutes: discharge as microseconds behind the synthetic epoch at admission."""
    o = A.table(spark, sf, "orders")
    whole = F.floor("o_totalprice").cast("bigint")
    patient = o.select(
        F.col("o_orderkey").alias("patientunitstayid"), F.col("o_custkey").cast("string").alias("uniquepid"), F.lit(0).alias("hospitaladmitoffset"),
        (whole % 9000).alias("unitdischargeoffset"), F.col("o_orderpriority").alias("unittype"),
    )
    rows = HO.admin_rows("eicu", {"patient": patient})
    return rows.select("stay_id", "patient_id", (F.unix_micros("outtime") - F.unix_micros("intime")).alias("after_epoch"), "first_careunit")


@query("plain_administration", """
SELECT o_orderkey AS stay_id, CAST(o_custkey AS VARCHAR) AS patient_id, CAST(NULL AS BIGINT) AS hadm_id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS intime,
  CASE family WHEN 'hirid' THEN NULL ELSE epoch_us(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY) END AS outtime, family
FROM orders, (VALUES ('hirid'), ('aumc'), ('sic')) f(family)""")
def plain_administration(spark, sf):
    """The same orders in the column names of three families."""
    o = A.table(spark, sf, "orders")
    begin = F.col("o_orderdate").cast("timestamp")
    end = begin + F.expr("INTERVAL 2 DAY")
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    given = {
        "hirid": ("general", o.select(key.alias("admissionid"), person.alias("person"), begin.alias("admissiontime"), key.alias("patientid"))),
        "aumc": ("admissions", o.select(key.alias("admissionid"), person.alias("patientid"), begin.alias("admittedat"), end.alias("dischargedat"))),
        "sic": ("cases", o.select(key.alias("caseid"), begin.alias("AdmissionOn"), end.alias("DischargeOn"))),
    }
    out = None
    for family, (table, rows) in given.items():
        got = HO.admin_rows(family, {table: rows})
        if family != "aumc":  # these name the stay as the patient
            got = got.join(o.select(key.alias("stay_id"), person.cast("string").alias("_p")), "stay_id").withColumn("patient_id", F.col("_p")).drop("_p")
        got = got.withColumn("family", F.lit(family))
        out = got if out is None else out.unionByName(got)
    return out.withColumns({c: F.unix_micros(c) for c in ("intime", "outtime")})


@query("flag_mortality", """
SELECT o_orderkey AS stay_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderstatus = 'F' AS INTEGER) END AS hospital_expire_flag, CAST(NULL AS BIGINT) AS death_time, 9 AS n_columns FROM orders""")
def flag_mortality(spark, sf):
    """From a flag where there is one, all null where there is none."""
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stay_id"), (F.col("o_orderstatus") == "F").alias("death"))
    flagged = HO.build_mortality_info("hirid", {}, o, o.filter("stay_id % 2 = 0"))
    plain = HO.build_mortality_info("hirid", {}, o.filter("stay_id % 2 = 1"))
    both = flagged.unionByName(plain)
    return both.select("stay_id", "hospital_expire_flag", F.unix_micros("death_time").alias("death_time"), F.lit(len(both.columns)).alias("n_columns"))


class _Tables:
    """The given tables as an export, without those stays that ``keep`` drops."""

    name = "miiv"

    def __init__(self, spark, sf, keep="true"):
        self.spark, self.sf, self.keep = spark, sf, keep

    def stays(self):
        return A.stays(self.spark, self.sf).filter(self.keep)

    def source(self, name):
        return A.hourly(self.spark, self.sf)


_ANY = " OR ".join(f"{f}_mask" for f in FE)


@query("dataset_build", W(_G, "").rstrip() + f""",
seen AS (SELECT DISTINCT stay_id FROM grid WHERE {_ANY}), kept AS (SELECT s.* FROM stays s JOIN seen USING (stay_id) WHERE los_days >= 1.0)
SELECT step, verdict, count(*) AS n_stays, count(*) AS n_said, count(*) AS n_series, count(*) AS n_labels, round(sum(greatest(0, los_days - 1)), 4) AS total_los
FROM (SELECT 1 AS step, 'rebuilt' AS verdict, los_days FROM kept WHERE stay_id % 3 > 0 UNION ALL SELECT 2, 'appended', los_days FROM kept
  UNION ALL SELECT 3, 'rebuilt', los_days FROM kept) GROUP BY step, verdict""")
def dataset_build(spark, sf):
    """A build of some stays, one that adds the rest, and one after a changed input: counts of metadata and tables."""
    path = new_folder(spark, "dataset")
    los = TaskConfig("los_remaining", "los", task_type="regression", observation_hours=24)
    out = None
    for step, (keep, signature) in enumerate((("stay_id % 3 > 0", "a"), ("true", "a"), ("true", "b")), 1):
        verdict = B.build_dataset(spark, _Tables(spark, sf, keep), [los], path, signature, length=T, min_stay_hours=24, exported_hours=A.HOURS)
        data = TB.load_dataset(spark, path)
        row = data["static"].agg(F.count(F.lit(1)).alias("n_stays")).crossJoin(data["metadata"].select(F.col("n_stays").alias("n_said"))).crossJoin(
            data["timeseries"].agg(F.count(F.lit(1)).alias("n_series"))
        ).crossJoin(data["labels"].agg(F.count("los_remaining").alias("n_labels"), F.round(F.sum("los_remaining"), 4).alias("total_los")))  # one-row frames
        row = stage(row.select(F.lit(step).alias("step"), F.lit(verdict).alias("verdict"), "*"), "step")
        out = row if out is None else out.unionByName(row)
    return out


@query("stored_statistics", W(_N, "SELECT feature_idx, feature, round(mean, 8) AS mean, round(std, 8) AS std, n_obs, 2::BIGINT AS n_reads FROM fstats"))
def stored_statistics(spark, sf):
    """Statistics that are computed once for a train set and read back the second time."""
    path = new_folder(spark, "stats")
    assigned = split_stays(spark, sf)
    key = N.split_hash(assigned).first()["split_hash"]
    rows = grid(spark, sf).join(assigned.select("stay_id", "split"), "stay_id")
    first = N.stored_or_computed(spark, path, key, lambda: N.feature_stats(rows, FE))
    again = N.stored_or_computed(spark, path, key, lambda: rows.limit(0).select(F.lit(0).alias("feature_idx")))
    both = first.unionByName(again).groupBy("feature_idx", "feature", "mean", "std", "n_obs").agg(F.count(F.lit(1)).alias("n_reads"))
    return both.withColumns({c: F.round(c, 8) for c in ("mean", "std")})
