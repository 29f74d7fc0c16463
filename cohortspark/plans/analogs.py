"""The given tables read as cohort data, and the same mappings as SQL subqueries.

events: a user's week is a stay, the hour of the week is the hour, the event type is
the feature. customer: demographics. lineitem and orders: predictions and run records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.config import ConceptRule, TaskConfig
from cohortspark.operators import events as EV
from cohortspark.plans.registry import CTES

WEEK_US = 604_800_000_000
HOUR_US = 3_600_000_000
START_US = 1_704_067_200_000_000  # 2024-01-01 UTC
HOURS = 168

FEATURES = ["click", "error", "purchase", "signup", "view"]
RULES = [
    ConceptRule("click", "mean", match=("click",), lo=0.0, hi=300.0),
    ConceptRule("error", "last", match=("error",)),
    ConceptRule("purchase", "max", match=("purchase",), lo=1.0),
    ConceptRule("signup", "any", match=("signup",)),
    ConceptRule("view", "sum", match=("view",)),
]

GENDER_TEXT = {
    "AUTOMOBILE": "M", "BUILDING": " male", "FURNITURE": "Unknown", "HOUSEHOLD": "FEMALE",
    "MACHINERY": "f ",
}
RACE_TEXT = [
    "WHITE - RUSSIAN", "BLACK/AFRICAN AMERICAN", "HISPANIC/LATINO", "ASIAN_CHINESE", "UNKNOWN",
    "AMERICAN INDIAN",
]

AKI = TaskConfig(
    "aki_kdigo", "aki", prediction_hours=96, observation_hours=72, sources=("stays", "timeseries"),
    params={"baseline_window_hours": 72, "absolute_rise_threshold": 30.0,
            "relative_rise_threshold": 1.5},
)
LOS = TaskConfig("los_remaining", "los", task_type="regression", observation_hours=24)
DEATH_24 = TaskConfig(
    "mortality_24h", "mortality", prediction_hours=48, observation_hours=48, gap_hours=6,
    sources=("stays", "mortality_info"),
)
HOSPITAL = TaskConfig(
    "mortality_hospital", "mortality", observation_hours=48, sources=("stays", "mortality_info"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with stay, hour and label, not yet matched to features."""
    e = table(spark, sf, "events")
    since = micros("ts") - F.lit(START_US)
    return e.select(
        "event_id",
        (F.col("user_id") * 100 + F.floor(since / WEEK_US)).cast("bigint").alias("stay_id"),
        "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.pmod(F.floor(since / HOUR_US), F.lit(HOURS)).cast("int").alias("hour"),
        F.col("event_type").alias("label"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
    )


CTES["ev"] = f"""
SELECT event_id, user_id * 100 + (epoch_us(ts) - {START_US}) // {WEEK_US} AS stay_id, user_id, ts,
  CAST(((epoch_us(ts) - {START_US}) // {HOUR_US}) % {HOURS} AS INTEGER) AS hour,
  event_type AS label, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id
FROM events"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events matched to features, values cleaned."""
    return EV.apply_concept_rules(raw_events(spark, sf), RULES)


CTES["cleaned"] = """
SELECT event_id, stay_id, user_id, ts, hour, label AS feature,
  CASE WHEN label = 'click' AND NOT (value >= 0 AND value <= 300) THEN NULL
       WHEN label = 'purchase' AND NOT value >= 1 THEN NULL ELSE value END AS value
FROM ev"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Wide hourly features with masks."""
    return EV.hourly_bins(events(spark, sf), RULES, max_hour=HOURS)


CTES["hourly"] = """
SELECT *, click IS NOT NULL AS click_mask, error IS NOT NULL AS error_mask,
  purchase IS NOT NULL AS purchase_mask, signup IS NOT NULL AS signup_mask,
  view IS NOT NULL AS view_mask
FROM (SELECT stay_id, hour,
  avg(value) FILTER (feature = 'click') AS click,
  arg_max(value, (ts, event_id)) FILTER (feature = 'error' AND value IS NOT NULL) AS error,
  max(value) FILTER (feature = 'purchase') AS purchase,
  max(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END) FILTER (feature = 'signup' AND value IS NOT NULL)::DOUBLE AS signup,
  sum(value) FILTER (feature = 'view') AS view
  FROM cleaned GROUP BY stay_id, hour)"""


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """One row per stay with times and demographics."""
    per = raw_events(spark, sf).groupBy("stay_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("outtime"),
    )
    week = F.col("stay_id") % 100
    base = per.select(
        "stay_id", F.floor(F.col("stay_id") / 100).cast("bigint").alias("user_id"),
        F.timestamp_micros(F.lit(START_US) + week * F.lit(WEEK_US)).alias("intime"), "outtime",
        ((F.unix_micros("outtime") - F.unix_micros("first_ts")) / F.lit(86_400_000_000.0)).alias("los_days"),
    )
    c = table(spark, sf, "customer")
    gender = F.create_map(*[F.lit(x) for kv in GENDER_TEXT.items() for x in kv])
    races = F.array(*[F.lit(r) for r in RACE_TEXT])
    people = c.select(
        F.col("c_custkey").alias("user_id"), F.round(F.col("c_acctbal") / 100.0, 1).alias("age"),
        gender[F.col("c_mktsegment")].alias("gender"),
        F.get(races, F.col("c_nationkey") % 6).alias("race"),
        F.when(F.col("c_nationkey") % 2 == 0, "miiv").otherwise("eicu").alias("source_dataset"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
    )
    return base.join(people, "user_id", "left").select(
        "stay_id", F.col("user_id").cast("string").alias("patient_id"),
        F.col("user_id").alias("hadm_id"), "intime", "outtime", "los_days", "age", "gender", "race",
        "source_dataset", "segment", "nation",
    )


_GENDER_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GENDER_TEXT.items())
_RACE_SQL = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(RACE_TEXT))
CTES["stays"] = f"""
SELECT s.stay_id, CAST(s.user_id AS VARCHAR) AS patient_id, s.user_id AS hadm_id, s.intime, s.outtime,
  s.los_days, round(c_acctbal / 100.0, 1) AS age, CASE c_mktsegment {_GENDER_SQL} END AS gender,
  CASE c_nationkey % 6 {_RACE_SQL} END AS race,
  CASE WHEN c_nationkey % 2 = 0 THEN 'miiv' WHEN c_nationkey IS NOT NULL THEN 'eicu' ELSE 'eicu' END AS source_dataset,
  c_mktsegment AS segment, c_nationkey AS nation
FROM (SELECT stay_id, stay_id // 100 AS user_id, max(ts) AS outtime,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(7 * (stay_id % 100) AS INTEGER)) AS intime,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS los_days
      FROM ev GROUP BY stay_id) s
LEFT JOIN customer ON c_custkey = s.user_id"""


def mortality(spark: SparkSession, sf: str) -> DataFrame:
    """Death facts per stay: the last error is the death, its precision cycles by stay."""
    ev = raw_events(spark, sf)
    per = ev.groupBy("stay_id").agg(
        F.max(F.when(F.col("label") == "error", F.col("ts"))).alias("dead_at"),
        F.max("ts").alias("dischtime"),
    )
    sid = F.col("stay_id")
    kind = F.when(sid % 3 == 0, "timestamp").when(sid % 3 == 1, "date")
    kind = F.when(F.col("dead_at").isNotNull(), kind)
    return per.select(
        "stay_id", F.when(kind == "timestamp", F.col("dead_at")).alias("death_time"),
        F.when(kind == "date", F.col("dead_at").cast("date")).alias("death_date"),
        kind.alias("death_time_precision"), F.lit("analog").alias("death_source"),
        F.when(sid % 5 == 0, 1).when(sid % 5 <= 2, 0).alias("hospital_expire_flag"),
        "dischtime",
        F.when(sid % 7 == 0, " Expired ").otherwise("HOME").alias("discharge_location"),
    )


CTES["mortality"] = """
SELECT stay_id, CASE WHEN stay_id % 3 = 0 THEN dead_at END AS death_time,
  CASE WHEN stay_id % 3 = 1 THEN CAST(dead_at AS DATE) END AS death_date,
  CASE WHEN dead_at IS NULL THEN NULL WHEN stay_id % 3 = 0 THEN 'timestamp' WHEN stay_id % 3 = 1 THEN 'date' END AS death_time_precision,
  CASE WHEN stay_id % 5 = 0 THEN 1 WHEN stay_id % 5 <= 2 THEN 0 END AS hospital_expire_flag,
  dischtime, CASE WHEN stay_id % 7 = 0 THEN ' Expired ' ELSE 'HOME' END AS discharge_location
FROM (SELECT stay_id, max(ts) FILTER (label = 'error') AS dead_at, max(ts) AS dischtime FROM ev GROUP BY stay_id)"""


def creatinine(spark: SparkSession, sf: str) -> DataFrame:
    """(stay_id, hour, crea): the hour's mean value over all events."""
    return raw_events(spark, sf).groupBy("stay_id", "hour").agg(F.avg("value").alias("crea"))


CTES["crea"] = "SELECT stay_id, hour, avg(value) AS crea FROM ev GROUP BY stay_id, hour"


def label_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "stays": stays(spark, sf), "mortality_info": mortality(spark, sf),
        "timeseries": creatinine(spark, sf),
    }


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Per lineitem row: a score with ties, a label, groups and two more scores."""
    li = table(spark, sf, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100).cast("bigint")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("stay_id"),
        F.col("l_suppkey").alias("patient_id"), F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line"),
        ((cents % 1009) / F.lit(1009.0)).alias("prediction"),
        ((F.floor(F.col("l_quantity")).cast("bigint") * 7 + cents % 13) % 97 / F.lit(97.0)).alias("prediction_b"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_quantity") / 50.0).alias("target"),
    )


CTES["pred"] = """
SELECT l_orderkey * 8 + l_linenumber AS stay_id, l_suppkey AS patient_id, l_linestatus AS status,
  l_linenumber AS line, (CAST(floor(l_extendedprice * 100) AS BIGINT) % 1009) / 1009.0 AS prediction,
  ((CAST(floor(l_quantity) AS BIGINT) * 7 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 13) % 97) / 97.0 AS prediction_b,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity / 50.0 AS target
FROM lineitem"""


def stay_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Per stay: a spread-out score and a label from its error count."""
    per = raw_events(spark, sf).groupBy("stay_id").agg(
        F.count_if(F.col("label") == "error").alias("n_error"), F.avg("value").alias("target")
    )
    return per.select(
        "stay_id", ((F.col("stay_id") * 7919) % 1000 / F.lit(1000.0)).alias("prediction"),
        (F.col("n_error") >= 3).cast("int").alias("label"), "target",
    )


CTES["spred"] = """
SELECT stay_id, ((stay_id * 7919) % 1000) / 1000.0 AS prediction,
  CAST(count(*) FILTER (label = 'error') >= 3 AS INTEGER) AS label, avg(value) AS target
FROM ev GROUP BY stay_id"""
