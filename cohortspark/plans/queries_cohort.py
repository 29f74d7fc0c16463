"""Registered queries: events, stays, cohort selection, labels, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.config import ConceptRule, Criterion, Slot, TaskConfig
from cohortspark.functions import values as V
from cohortspark.operators import cohort as CO
from cohortspark.operators import combine as U
from cohortspark.operators import events as EV
from cohortspark.operators import gates as G
from cohortspark.operators import labels as L
from cohortspark.operators import mortality as M
from cohortspark.operators import splits as S
from cohortspark.plans import analogs as A
from cohortspark.plans.registry import CTES, query
from cohortspark.plans.registry import with_tables as W


def r6(df, *names):
    """Round the named columns to 6 places."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- binning -----------------------------------------------------------------------------

@query("hourly_bins", W("ev cleaned hourly", """
SELECT stay_id, hour, round(click, 6) AS click, error, purchase, signup, round(view, 6) AS view,
  click_mask, error_mask, purchase_mask, signup_mask, view_mask FROM hourly"""))
def hourly_bins(spark, sf):
    return r6(A.hourly(spark, sf), "click", "view")


CTES["matched"] = """
SELECT * FROM (
  SELECT event_id, stay_id, 'low_item' AS feature, value FROM ev WHERE item_id IN (1, 2, 3, 5, 8, 13)
  UNION ALL SELECT event_id, stay_id, 'clicks' AS feature, value / 10.0 FROM ev WHERE label = 'click'
  UNION ALL SELECT event_id, stay_id, 'e_or_p' AS feature, value FROM ev WHERE regexp_matches(label, '^(e|p)')
  UNION ALL SELECT event_id, stay_id, 'item_code' AS feature, CAST(item_id AS DOUBLE) FROM ev WHERE item_id IS NOT NULL)"""


@query("concept_rules", W("ev matched", """
SELECT feature, count(*) AS n, count(v) AS n_kept, round(sum(v), 4) AS total FROM (
  SELECT feature, CASE WHEN feature = 'e_or_p' AND value > 100 THEN NULL
    WHEN feature = 'item_code' AND value < 10 THEN NULL ELSE value END AS v FROM matched)
GROUP BY feature"""))
def concept_rules(spark, sf):
    EV.TRANSFORMS.setdefault("tenth", lambda v: v / 10.0)
    rules = [
        ConceptRule("low_item", kind="item", match=(1, 2, 3, 5, 8, 13)),
        ConceptRule("clicks", kind="string", match=("click",), transform="tenth"),
        ConceptRule("e_or_p", kind="regex", match=("^(e|p)",), hi=100.0),
        ConceptRule("item_code", kind="column", match=("item_id",), lo=10.0),
    ]
    rows = EV.apply_concept_rules(A.raw_events(spark, sf), rules)
    return rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_kept"),
        F.round(F.sum("value"), 4).alias("total"),
    )


@query("merge_batches", W("ev cleaned", """
SELECT stay_id, hour, round(click, 6) AS click, purchase FROM
 (SELECT stay_id, hour, avg(value) AS click FROM cleaned WHERE feature = 'click' GROUP BY 1, 2) a
 FULL JOIN (SELECT stay_id, hour, max(value) AS purchase FROM cleaned WHERE feature = 'purchase' GROUP BY 1, 2) b
 USING (stay_id, hour)"""))
def merge_batches(spark, sf):
    ev = A.events(spark, sf)
    by = {r.feature: r for r in A.RULES}
    one = [EV.hourly_bins(ev, [by[f]]).select("stay_id", "hour", f) for f in ("click", "purchase")]
    return r6(EV.merge_batches(one, ["click", "purchase"]), "click")


@query("gap_filled_hours", W("ev cleaned hourly stays", """
SELECT stay_id, hour, error, coalesce(error_mask, false) AS error_mask FROM
 (SELECT stay_id, CAST(unnest(range(CAST(least(ceil(los_days * 24), 48) AS BIGINT))) AS INTEGER) AS hour
  FROM stays) LEFT JOIN hourly USING (stay_id, hour)"""))
def gap_filled_hours(spark, sf):
    full = EV.fill_stay_hours(A.hourly(spark, sf), A.stays(spark, sf), A.FEATURES, 48, unique=True)
    return full.select("stay_id", "hour", "error", "error_mask")


@query("keep_last_rows", W("ev", """
SELECT stay_id, hour, event_id, label, value FROM ev
QUALIFY row_number() OVER (PARTITION BY stay_id, hour ORDER BY ts DESC, event_id DESC) = 1"""))
def keep_last_rows(spark, sf):
    ev = A.raw_events(spark, sf).select("stay_id", "hour", "event_id", "label", "value", "ts")
    return EV.keep_last(ev, ["stay_id", "hour"], ["ts", "event_id"]).drop("ts")


@query("duplicate_hours", W("ev", """
SELECT count(*) AS rows, count(DISTINCT (stay_id, hour)) AS distinct_keys,
  count(*) - count(DISTINCT (stay_id, hour)) AS removed FROM ev"""))
def duplicate_hours(spark, sf):
    return EV.duplicate_report(A.raw_events(spark, sf), ["stay_id", "hour"])


# --- stays and filters ----------------------------------------------------------------------

@query("stays_table", W("ev stays", """
SELECT stay_id, patient_id, hadm_id, epoch_us(intime) AS intime_us, epoch_us(outtime) AS outtime_us,
  round(los_days, 6) AS los_days, age, gender, race, source_dataset FROM stays"""))
def stays_table(spark, sf):
    s = A.stays(spark, sf)
    return s.select(
        "stay_id", "patient_id", "hadm_id", F.unix_micros("intime").alias("intime_us"),
        F.unix_micros("outtime").alias("outtime_us"), F.round("los_days", 6).alias("los_days"),
        "age", "gender", "race", "source_dataset",
    )


@query("los_report", W("ev stays", """
SELECT count(*) AS n_stays, count(*) FILTER (los_days IS NULL) AS n_null_los,
  count(*) FILTER (los_days < 0) AS n_negative_los, count(*) FILTER (los_days < 1) AS n_short FROM stays"""))
def los_report(spark, sf):
    return CO.los_report(A.stays(spark, sf))


@query("cohort_stays", W("ev stays", """
SELECT stay_id, patient_id, round(los_days, 6) AS los_days FROM stays
WHERE los_days IS NOT NULL AND los_days >= 0 AND los_days >= 1.0"""))
def cohort_stays(spark, sf):
    kept = CO.min_stay(CO.valid_los(A.stays(spark, sf)))
    return kept.select("stay_id", "patient_id", F.round("los_days", 6).alias("los_days"))


@query("hour_report", W("ev", """
SELECT count(*) FILTER (hour < 48) AS n_valid, count(*) FILTER (hour >= 48) AS n_overflow,
  max(hour) AS max_hour FROM ev"""))
def hour_report(spark, sf):
    return CO.hour_report(A.raw_events(spark, sf), 48)


@query("model_features", """
SELECT p_type AS feature, count(*) AS n FROM part WHERE p_type NOT IN ('LARGE', 'PROMO') GROUP BY p_type""")
def model_features(spark, sf):
    names = A.table(spark, sf, "part").select(F.col("p_type").alias("feature"))
    return CO.model_features(names, ("LARGE", "PROMO")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("discover_concepts", W("ev", """
SELECT DISTINCT label AS feature FROM ev WHERE label NOT IN (SELECT label FROM ev GROUP BY label HAVING avg(value) > 50)"""))
def discover_concepts(spark, sf):
    ev = A.raw_events(spark, sf).select(F.col("label").alias("feature"), "value")
    names = ev.select("feature").distinct()
    static = ev.groupBy("feature").agg(F.avg("value").alias("m")).filter("m > 50")
    return CO.discover_concepts(names, static.select("feature"))


@query("drop_blocked_columns", W("ev cleaned hourly", """
SELECT stay_id, hour, error, purchase FROM hourly"""))
def drop_blocked_columns(spark, sf):
    return CO.drop_blocked(A.hourly(spark, sf), ("click", "signup", "view")).select(
        "stay_id", "hour", "error", "purchase"
    )


@query("complete_stay_columns", W("ev stays", """
SELECT stay_id, patient_id, hadm_id, round(los_days, 6) AS los_days, age, gender, race,
  CAST(NULL AS VARCHAR) AS insurance FROM stays"""))
def complete_stay_columns(spark, sf):
    from cohortspark import schemas

    full = CO.complete_columns(A.stays(spark, sf), schemas.STAYS)
    return r6(
        full.select("stay_id", "patient_id", "hadm_id", "los_days", "age", "gender", "race", "insurance"),
        "los_days",
    )


@query("safe_static", W("ev stays", "SELECT stay_id, age, gender FROM stays"))
def safe_static(spark, sf):
    return CO.safe_static(A.stays(spark, sf))


@query("slot_predicates", W("ev stays", """
SELECT count(*) FILTER (age = 30) AS eq, count(*) FILTER (age <> 30) AS ne, count(*) FILTER (age < 30) AS lt,
  count(*) FILTER (age > 30) AS gt, count(*) FILTER (age <= 30) AS le, count(*) FILTER (age >= 30) AS ge,
  count(*) FILTER (segment IN ('BUILDING', 'MACHINERY')) AS one_of,
  count(*) FILTER (los_days >= 1 AND los_days < 3) AS half_open FROM stays"""))
def slot_predicates(spark, sf):
    tests = {
        "eq": ("age", "==", 30), "ne": ("age", "!=", 30), "lt": ("age", "<", 30),
        "gt": ("age", ">", 30), "le": ("age", "<=", 30), "ge": ("age", ">=", 30),
        "one_of": ("segment", "in", ("BUILDING", "MACHINERY")),
        "half_open": ("los_days", "between", (1, 3)),
    }
    return A.stays(spark, sf).agg(
        *[F.count_if(CO.predicate(*p)).alias(n) for n, p in tests.items()]
    )


@query("key_subset", W("ev cleaned hourly stays", """
SELECT stay_id, count(*) AS n_rows FROM hourly
WHERE stay_id IN (SELECT stay_id FROM stays WHERE segment = 'BUILDING') GROUP BY stay_id"""))
def key_subset(spark, sf):
    ids = A.stays(spark, sf).filter("segment = 'BUILDING'").select("stay_id")
    rows = CO.only_stays(A.hourly(spark, sf), ids)
    return rows.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("key_exclusion", W("ev stays", """
SELECT stay_id FROM stays WHERE stay_id NOT IN (SELECT stay_id FROM ev WHERE label = 'error')"""))
def key_exclusion(spark, sf):
    seen = A.raw_events(spark, sf).filter("label = 'error'")
    return CO.without_stays(A.stays(spark, sf), seen).select("stay_id")


@query("literal_key_scan", """
SELECT event_id, user_id, value FROM events WHERE user_id IN (3, 5, 8, 13, 21)""")
def literal_key_scan(spark, sf):
    from cohortspark.sources.tables import key_filter, read_parquet

    e = read_parquet(spark, f"{sf}/events.parquet", columns=["event_id", "user_id", "value"])
    return key_filter(e, [3, 5, 8, 13, 21], "user_id")


@query("source_dispatch", W("ev stays", """
SELECT stay_id, n FROM (SELECT stay_id, count(*) AS n FROM ev GROUP BY stay_id)
WHERE stay_id IN (SELECT stay_id FROM stays WHERE los_days >= 5)"""))
def source_dispatch(spark, sf):
    from cohortspark.sources.tables import DatasetSource

    class Analog(DatasetSource):
        def stays(self):
            return A.stays(spark, sf)

        def timeseries(self, ids=None):
            return A.raw_events(spark, sf)

    src = Analog()
    long = src.stays().filter("los_days >= 5").select("stay_id")
    return src.source("timeseries", long).groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))


# --- people and bins ------------------------------------------------------------------------------

@query("demographic_groups", W("ev stays", """
SELECT gender_g, race_g, age_g, count(*) AS n FROM (SELECT
  CASE lower(trim(gender)) WHEN 'm' THEN 'M' WHEN 'male' THEN 'M' WHEN 'f' THEN 'F' WHEN 'female' THEN 'F' END AS gender_g,
  CASE WHEN source_dataset <> 'miiv' THEN NULL WHEN race = 'UNKNOWN' THEN NULL WHEN race LIKE 'HISP%' THEN 'Hispanic'
    WHEN race LIKE 'BLACK%' THEN 'Black' WHEN race LIKE 'ASIAN%' THEN 'Asian' WHEN race LIKE 'WHITE%' THEN 'White'
    WHEN race IS NOT NULL THEN 'Other' END AS race_g,
  CASE WHEN age BETWEEN 18 AND 44 THEN '18-44' WHEN age BETWEEN 45 AND 64 THEN '45-64'
    WHEN age BETWEEN 65 AND 79 THEN '65-79' WHEN age >= 80 THEN '80+' END AS age_g
  FROM stays) GROUP BY ALL"""))
def demographic_groups(spark, sf):
    s = A.stays(spark, sf).select(
        V.gender_group("gender").alias("gender_g"),
        V.race_group("race", "source_dataset").alias("race_g"), V.age_group("age").alias("age_g"),
    )
    return s.groupBy("gender_g", "race_g", "age_g").agg(F.count(F.lit(1)).alias("n"))


@query("report_bins", W("ev stays", """
SELECT age_bin, los_bin, los_cut, count(*) AS n FROM (SELECT
  CASE WHEN age < 40 THEN '<40' WHEN age < 60 THEN '40-59' WHEN age < 80 THEN '60-79' WHEN age IS NOT NULL THEN '80+' END AS age_bin,
  CASE WHEN los_days < 1 THEN '<1' WHEN los_days < 3 THEN '1-3' WHEN los_days < 7 THEN '3-7' ELSE '7+' END AS los_bin,
  CASE WHEN los_days <= 1 THEN '<1d' WHEN los_days <= 3 THEN '1-3d' WHEN los_days <= 7 THEN '3-7d' ELSE '>7d' END AS los_cut
  FROM stays) GROUP BY ALL"""))
def report_bins(spark, sf):
    s = A.stays(spark, sf).select(
        V.report_bins("age", (40, 60, 80), ("<40", "40-59", "60-79", "80+")).alias("age_bin"),
        V.report_bins("los_days", (1, 3, 7), ("<1", "1-3", "3-7", "7+")).alias("los_bin"),
        V.cut_right_closed("los_days", (1, 3, 7), ("<1d", "1-3d", "3-7d", ">7d")).alias("los_cut"),
    )
    return s.groupBy("age_bin", "los_bin", "los_cut").agg(F.count(F.lit(1)).alias("n"))


@query("category_codes", W("ev", """
SELECT stay_id, hour, CASE label WHEN 'view' THEN 0.0 WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 2.0 END::DOUBLE AS label,
  label IN ('view', 'click', 'purchase') AS label_mask, event_id FROM ev"""))
def category_codes(spark, sf):
    ev = A.raw_events(spark, sf).withColumn("label_mask", F.lit(True))
    coded = V.encode_categories(ev, {"label": {"view": 0.0, "click": 1.0, "purchase": 2.0}})
    return coded.select("stay_id", "hour", "event_id", "label", "label_mask")


@query("duration_hours", W("ev", """
SELECT stay_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0, 6) AS hours FROM ev GROUP BY stay_id"""))
def duration_hours(spark, sf):
    per = A.raw_events(spark, sf).groupBy("stay_id").agg((F.max("ts") - F.min("ts")).alias("hours"))
    return r6(V.intervals_to_hours(per), "hours")


# --- samples --------------------------------------------------------------------------------------------

@query("extreme_stays", W("ev stays", """
(SELECT stay_id, 'min' AS extreme FROM stays WHERE los_days IS NOT NULL ORDER BY los_days, stay_id LIMIT 5)
UNION ALL (SELECT stay_id, 'max' AS extreme FROM stays WHERE los_days IS NOT NULL ORDER BY los_days DESC, stay_id LIMIT 5)"""))
def extreme_stays(spark, sf):
    return CO.extreme_stays(A.stays(spark, sf), "los_days", 5).select("stay_id", "extreme")


@query("first_stays", W("ev", "SELECT DISTINCT stay_id FROM ev ORDER BY stay_id LIMIT 10"))
def first_stays(spark, sf):
    return CO.first_stays(A.raw_events(spark, sf).select("stay_id").distinct(), 10)


_DRAW = "CAST('0x' || substr(md5('{seed}|' || CAST({id} AS VARCHAR)), 1, 15) AS BIGINT)"
DRAW = lambda seed, ident: _DRAW.format(seed=seed, id=ident)


@query("stratified_sample", W("ev stays", f"""
SELECT stay_id, slot_name FROM (SELECT stay_id, los || '_' || a AS slot_name FROM (SELECT stay_id,
  CASE WHEN los_days <= 1 THEN '<1d' WHEN los_days <= 3 THEN '1-3d' WHEN los_days <= 7 THEN '3-7d' ELSE '>7d' END AS los,
  CASE WHEN age <= 40 THEN '<40' WHEN age <= 65 THEN '40-65' WHEN age > 65 THEN '>65' END AS a FROM stays))
WHERE slot_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY slot_name ORDER BY {DRAW(42, 'stay_id')}, stay_id) <= 2"""))
def stratified_sample(spark, sf):
    return CO.stratified_sample(A.stays(spark, sf), n_per_stratum=2).select("stay_id", "slot_name")


@query("value_strata_sample", W("ev stays", f"""
SELECT stay_id, segment AS slot_name FROM stays WHERE segment IN ('BUILDING', 'FURNITURE')
QUALIFY row_number() OVER (PARTITION BY segment ORDER BY {DRAW(7, 'stay_id')}, stay_id) <= 3"""))
def value_strata_sample(spark, sf):
    c = [Criterion("segment", values=("BUILDING", "FURNITURE"))]
    return CO.stratified_sample(A.stays(spark, sf), c, 3, seed=7).select("stay_id", "slot_name")


SLOTS = (
    Slot("shortest", (("los_days", "<", 2),), "los_days"),
    Slot("shortest_again", (("los_days", "<", 2),), "los_days"),
    Slot("youngest", (("age", "<", 40),), "age"),
    Slot("needs_missing_column", (("nothing", "<", 40),), "age"),
    Slot("oldest", (("age", ">", 80),), "age", True),
    Slot("any"),
)


@query("slot_selection", W("ev stays", f"""
, a AS (SELECT stay_id FROM stays WHERE los_days < 2 ORDER BY los_days, stay_id LIMIT 1)
, b AS (SELECT stay_id FROM stays WHERE los_days < 2 AND stay_id NOT IN (FROM a) ORDER BY los_days, stay_id LIMIT 1)
, c AS (SELECT stay_id FROM stays WHERE age < 40 AND stay_id NOT IN (FROM a UNION FROM b) ORDER BY age, stay_id LIMIT 1)
, d AS (SELECT stay_id FROM stays WHERE age > 80 AND stay_id NOT IN (FROM a UNION FROM b UNION FROM c) ORDER BY age DESC, stay_id LIMIT 1)
, e AS (SELECT stay_id FROM stays WHERE stay_id NOT IN (FROM a UNION FROM b UNION FROM c UNION FROM d) ORDER BY {DRAW(46, 'stay_id')}, stay_id LIMIT 1)
SELECT stay_id, 'shortest' AS slot_name FROM a UNION ALL SELECT stay_id, 'shortest_again' FROM b
UNION ALL SELECT stay_id, 'youngest' FROM c UNION ALL SELECT stay_id, 'oldest' FROM d UNION ALL SELECT stay_id, 'any' FROM e""".strip()))
def slot_selection(spark, sf):
    return CO.select_slots(A.stays(spark, sf), SLOTS).select("stay_id", "slot_name")


# --- joins -------------------------------------------------------------------------------------------------

@query("stay_dimension_joins", W("ev", """
SELECT s.stay_id, o.n_orders, round(o.spent, 2) AS spent FROM (SELECT DISTINCT stay_id, user_id FROM ev) s
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1) o ON o_custkey = user_id"""))
def stay_dimension_joins(spark, sf):
    s = A.raw_events(spark, sf).select("stay_id", "user_id").distinct()
    o = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    return s.join(o, "user_id", "left").drop("user_id")


@query("stay_assembly", W("ev stays", """
SELECT stay_id, CASE WHEN stay_id % 2 = 0 THEN patient_id END AS patient_id, CASE WHEN stay_id % 2 = 0 THEN hadm_id END AS hadm_id,
  round(los_days, 6) AS los_days, CASE WHEN stay_id % 3 > 0 THEN age END AS age, CAST(NULL AS VARCHAR) AS insurance, 14 AS n_columns FROM stays"""))
def stay_assembly(spark, sf):
    """Windows, demographics and administration of some stays; a column of the windows wins over the others'."""
    from cohortspark.sources.hospital import build_stays

    s = A.stays(spark, sf)
    people = s.filter("stay_id % 3 > 0").select("stay_id", "age")
    admin = s.filter("stay_id % 2 = 0").select("stay_id", "patient_id", "hadm_id", (F.col("los_days") + 1).alias("los_days"))
    built = build_stays(s.select("stay_id", "intime", "outtime", "los_days"), people, admin)
    shown = built.select("stay_id", "patient_id", "hadm_id", "los_days", "age", "insurance", F.lit(len(built.columns)).alias("n_columns"))
    return r6(shown, "los_days")


@query("diagnosis_expansion", W("ev stays", """
SELECT stay_id, o_orderpriority AS icd_code, count(*) AS n FROM stays JOIN orders ON o_custkey = hadm_id GROUP BY ALL"""))
def diagnosis_expansion(spark, sf):
    from cohortspark.sources.hospital import build_diagnoses

    icu = A.stays(spark, sf).select("stay_id", "hadm_id")
    diag = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("hadm_id"), F.col("o_orderpriority").alias("icd_code"),
        F.lit(10).alias("icd_version"),
    )
    rows = build_diagnoses("miiv", {"icustays": icu, "diagnoses_icd": diag})
    return rows.groupBy("stay_id", "icd_code").agg(F.count(F.lit(1)).alias("n"))


@query("code_lists", """
SELECT doc_id AS stay_id, trim(u.code) AS icd_code, count(*) AS n
FROM documents, unnest(string_split(lang || ', ' || source || ',,' || lang, ',')) AS u(code)
WHERE trim(u.code) <> '' GROUP BY ALL""")
def code_lists(spark, sf):
    from cohortspark.sources.hospital import clean_codes

    d = A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("stay_id"),
        F.concat("lang", F.lit(", "), "source", F.lit(",,"), "lang").alias("icd_code"),
    )
    return clean_codes(d).groupBy("stay_id", "icd_code").agg(F.count(F.lit(1)).alias("n"))


@query("mortality_assembly", W("ev stays", """
SELECT s.stay_id, CASE WHEN o.o_orderstatus = 'F' THEN 'timestamp' WHEN p.c_acctbal < 2000 THEN 'date' END AS precision,
  CASE WHEN o.o_orderstatus = 'F' THEN 'admissions.deathtime' WHEN p.c_acctbal < 2000 THEN 'patients.dod' END AS source,
  CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) END AS death_day,
  CASE WHEN o.o_orderstatus IS DISTINCT FROM 'F' AND p.c_acctbal < 2000 THEN DATE '2024-03-01' END AS death_date
FROM stays s LEFT JOIN customer p ON p.c_custkey = s.hadm_id
LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderdate, o_orderkey) AS o_orderdate
  FROM orders GROUP BY 1) o ON o.o_custkey = s.hadm_id"""))
def mortality_assembly(spark, sf):
    from cohortspark.sources.hospital import build_mortality_info

    s = A.stays(spark, sf)
    icu = s.select("stay_id", F.col("hadm_id").alias("subject_id"), "hadm_id")
    pat = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.when(F.col("c_acctbal") < 2000, F.lit("2024-03-01").cast("timestamp")).alias("dod"),
    )
    last = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("hadm_id")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("status"),
        F.max_by(F.col("o_orderdate").cast("timestamp"), "o_orderkey").alias("at"),
    )
    adm = last.select("hadm_id", F.when(F.col("status") == "F", F.col("at")).alias("deathtime"))
    info = build_mortality_info("miiv", {"icustays": icu, "patients": pat, "admissions": adm}, s)
    return info.select(
        "stay_id", F.col("death_time_precision").alias("precision"), F.col("death_source").alias("source"),
        F.to_date("death_time").alias("death_day"), "death_date",
    )


# --- labels ------------------------------------------------------------------------------------------------------

CTES["death"] = """
SELECT s.stay_id, s.intime, s.outtime, s.segment, m.* EXCLUDE (stay_id),
  coalesce(hospital_expire_flag = 1, false) OR lower(trim(discharge_location)) = 'expired' AS stated,
  coalesce(death_date <= CAST(dischtime AS DATE), false) AS early
FROM stays s LEFT JOIN mortality m USING (stay_id)"""
CTES["death2"] = """
SELECT *, stated OR death_time IS NOT NULL OR death_date IS NOT NULL AS ev_any,
  death_date IS NOT NULL AND (stated OR (hospital_expire_flag IS NULL AND early)) AS dated_h
FROM death"""
CTES["death3"] = """
SELECT *, stated OR death_time IS NOT NULL OR dated_h AS ev_h,
  coalesce(death_time, CASE WHEN ev_any AND death_date IS NULL THEN dischtime END) AS t_any,
  coalesce(death_time, CASE WHEN (stated OR death_time IS NOT NULL OR dated_h) AND death_date IS NULL THEN dischtime END) AS t_h,
  coalesce(hospital_expire_flag = 0, false) AND NOT ev_any AS surv,
  coalesce(hospital_expire_flag = 0, false) AND NOT (stated OR death_time IS NOT NULL OR dated_h) AS surv_h,
  CAST(death_date AS TIMESTAMP) AS d0, CAST(death_date AS TIMESTAMP) + INTERVAL '86399' SECOND AS d1
FROM death2"""
_DEATH = "ev stays mortality death death2 death3"


def _mortality(spark, sf, **kw):
    task = TaskConfig("m", "mortality", sources=("stays", "mortality_info"), **kw)
    return M.build_mortality(task, A.label_sources(spark, sf))


@query("mortality_hospital", W(_DEATH, """
SELECT stay_id, CASE WHEN ev_any THEN 1 WHEN surv THEN 0 END AS label FROM death3"""))
def mortality_hospital(spark, sf):
    return _mortality(spark, sf)


@query("mortality_hospital_observed", W(_DEATH, """
SELECT stay_id, CASE
  WHEN t_h IS NOT NULL AND t_h < intime + INTERVAL 48 HOUR THEN NULL
  WHEN t_h IS NULL AND dated_h AND d1 < intime + INTERVAL 48 HOUR THEN NULL
  WHEN t_h IS NULL AND dated_h AND d0 < intime + INTERVAL 48 HOUR AND d1 >= intime + INTERVAL 48 HOUR THEN NULL
  WHEN ev_h THEN 1 WHEN surv_h THEN 0 END AS label FROM death3"""))
def mortality_hospital_observed(spark, sf):
    return _mortality(spark, sf, observation_hours=48)


@query("mortality_unit", W(_DEATH, """
SELECT stay_id, CASE WHEN t_any IS NOT NULL THEN CAST(t_any <= outtime AS INTEGER)
  WHEN death_date IS NOT NULL THEN CAST(death_date <= CAST(outtime AS DATE) AS INTEGER)
  WHEN surv THEN 0 END AS label FROM death3"""))
def mortality_unit(spark, sf):
    return _mortality(spark, sf, prediction_hours=-1)


@query("mortality_from_admission", W(_DEATH, """
SELECT stay_id, CASE WHEN t_any IS NOT NULL THEN CAST(t_any <= b AS INTEGER)
  WHEN death_date IS NOT NULL THEN CASE WHEN d1 <= b THEN 1 WHEN d0 <= b AND b < d1 THEN CASE WHEN surv THEN 0 END ELSE 0 END
  WHEN surv THEN 0 END AS label FROM (SELECT *, intime + INTERVAL 100 HOUR AS b FROM death3)"""))
def mortality_from_admission(spark, sf):
    return _mortality(spark, sf, prediction_hours=100)


def _windowed_sql(obs, gap, end):
    return W(_DEATH, f"""
SELECT stay_id, CASE
  WHEN t_any IS NOT NULL THEN CASE WHEN t_any < oe THEN NULL
    WHEN {gap} > 0 AND t_any > oe AND t_any < ps THEN NULL WHEN t_any >= ps AND t_any <= pe THEN 1 ELSE 0 END
  WHEN death_date IS NOT NULL THEN CASE
    WHEN (d0 < oe AND d1 >= oe) OR (d0 < ps AND d1 >= ps) OR (d0 <= pe AND d1 > pe) THEN NULL
    WHEN d1 < oe THEN NULL WHEN {gap} > 0 AND d0 > oe AND d1 < ps THEN NULL
    WHEN d0 >= ps AND d1 <= pe THEN 1 ELSE 0 END
  WHEN surv THEN 0 END AS label
FROM (SELECT *, intime + INTERVAL {obs} HOUR AS oe, intime + INTERVAL {obs + gap} HOUR AS ps, {end} AS pe FROM death3)""")


@query("mortality_windowed", _windowed_sql(48, 6, "intime + INTERVAL 102 HOUR"))
def mortality_windowed(spark, sf):
    return _mortality(spark, sf, observation_hours=48, gap_hours=6, prediction_hours=48)


@query("mortality_until_discharge", _windowed_sql(24, 0, "outtime"))
def mortality_until_discharge(spark, sf):
    return _mortality(spark, sf, observation_hours=24, prediction_hours=-1)


@query("legacy_mortality", W("ev stays mortality", """
SELECT stay_id, CASE WHEN death_date IS NOT NULL OR death_time IS NOT NULL THEN 'date' END AS death_time_precision,
  CAST(coalesce(death_time, death_date) AS DATE) AS death_date, 'legacy' AS death_source FROM mortality"""))
def legacy_mortality(spark, sf):
    m = A.mortality(spark, sf)
    old = m.select(
        "stay_id", F.coalesce("death_time", F.col("death_date").cast("timestamp")).alias("date_of_death")
    )
    return M.complete_mortality(old).select(
        "stay_id", "death_time_precision", "death_date", "death_source"
    )


CTES["rise"] = """
SELECT stay_id, min(crea) FILTER (hour < 72) AS base,
  count(*) FILTER (hour >= 72 AND hour < 168) AS n_late,
  max(crea) FILTER (hour >= 72 AND hour < 168) AS peak,
  max(crea - floor48) FILTER (hour >= 72 AND hour < 168) AS rise
FROM (SELECT *, min(crea) OVER (PARTITION BY stay_id ORDER BY hour RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING) AS floor48 FROM crea)
GROUP BY stay_id"""
CTES["aki"] = """
SELECT stay_id, CASE WHEN base IS NULL THEN NULL WHEN n_late = 0 THEN NULL
  WHEN peak >= base * 1.5 OR rise >= 30 THEN 1 ELSE 0 END AS label,
  CASE WHEN base IS NULL THEN 'no_creatinine_or_baseline' WHEN n_late = 0 THEN 'no_post_obs_creatinine' END AS null_reason
FROM (SELECT DISTINCT stay_id FROM ev) LEFT JOIN rise USING (stay_id)"""
_AKI = "ev crea rise aki"


@query("aki_labels", W(_AKI, "SELECT stay_id, label, null_reason FROM aki"))
def aki_labels(spark, sf):
    return L.aki_with_reasons(A.AKI, A.label_sources(spark, sf))


@query("absolute_rise", W("ev crea", """
SELECT DISTINCT b.stay_id FROM crea a JOIN crea b ON a.stay_id = b.stay_id AND b.hour > a.hour AND b.hour - a.hour <= 48
WHERE b.hour >= 72 AND b.hour < 168 AND b.crea - a.crea >= 30"""))
def absolute_rise(spark, sf):
    return L.rise_flags(A.creatinine(spark, sf), A.AKI).filter("absolute").select("stay_id")


@query("aki_null_reasons", W(_AKI, """
SELECT count(*) FILTER (null_reason = 'no_creatinine_or_baseline') AS no_creatinine_or_baseline,
  count(*) FILTER (null_reason = 'no_post_obs_creatinine') AS no_post_obs_creatinine FROM aki"""))
def aki_null_reasons(spark, sf):
    return L.null_reasons(L.aki_with_reasons(A.AKI, A.label_sources(spark, sf)))


@query("los_labels", W("ev stays", """
SELECT stay_id, round(CASE WHEN los_days IS NOT NULL THEN greatest(los_days - 1.0, 0.0) END, 6) AS label FROM stays"""))
def los_labels(spark, sf):
    return r6(L.build_los(A.LOS, A.label_sources(spark, sf)), "label")


def all_labels(spark, sf):
    return L.extract_labels([A.AKI, A.LOS, A.HOSPITAL], A.label_sources(spark, sf))


CTES["labels3"] = """
SELECT stay_id, a.label AS aki_kdigo, greatest(s.los_days - 1.0, 0.0) AS los_remaining,
  CASE
  WHEN t_h IS NOT NULL AND t_h < d.intime + INTERVAL 48 HOUR THEN NULL
  WHEN t_h IS NULL AND dated_h AND d0 < d.intime + INTERVAL 48 HOUR THEN NULL
  WHEN ev_h THEN 1 WHEN surv_h THEN 0 END AS mortality_hospital
FROM stays s JOIN aki a USING (stay_id) JOIN death3 d USING (stay_id)"""
_LAB = "ev stays mortality death death2 death3 crea rise aki labels3"


@query("multi_task_labels", W(_LAB, """
SELECT stay_id, aki_kdigo, round(los_remaining, 6) AS los_remaining, mortality_hospital FROM labels3"""))
def multi_task_labels(spark, sf):
    return r6(all_labels(spark, sf), "los_remaining")


@query("label_quality_by_group", W(_AKI + " stays", """
SELECT segment, count(*) AS total_stays, count(label) AS non_null_labels, count(*) - count(label) AS null_labels,
  round((count(*) - count(label)) * 100.0 / count(*), 6) AS null_percentage,
  count(*) FILTER (label = 1) AS positive_labels, count(*) FILTER (label = 0) AS negative_labels,
  round(count(*) FILTER (label = 1) / nullif(count(label), 0), 6) AS positive_prevalence
FROM stays LEFT JOIN aki USING (stay_id) WHERE los_days >= 1.0 GROUP BY segment"""))
def label_quality_by_group(spark, sf):
    """Events to hourly values, cohort filter, rise labels, quality numbers per segment."""
    src = A.label_sources(spark, sf)
    src["stays"] = CO.min_stay(CO.valid_los(src["stays"]))
    labelled = src["stays"].join(L.build_aki(A.AKI, src), "stay_id", "left")
    return r6(L.quality_stats(labelled, ["segment"]), "null_percentage", "positive_prevalence")


@query("class_distribution", W(_AKI + " stays", """
SELECT segment, label, n, round(n * 100.0 / tot, 6) AS pct, round(mx / mn, 6) AS imbalance_ratio,
  round(tot / (2.0 * n), 6) AS weight FROM (SELECT *, sum(n) OVER w AS tot, max(n) OVER w AS mx, min(n) OVER w AS mn
FROM (SELECT segment, label, count(*) AS n FROM stays JOIN aki USING (stay_id) WHERE label IS NOT NULL GROUP BY 1, 2)
WINDOW w AS (PARTITION BY segment))"""))
def class_distribution(spark, sf):
    src = A.label_sources(spark, sf)
    rows = src["stays"].join(L.build_aki(A.AKI, src), "stay_id")
    return r6(L.class_counts(rows, ["segment"]), "pct", "imbalance_ratio", "weight")


_SUMMARY = """count({y}) AS n, round(avg({y}), 4) AS mean, round(coalesce(stddev_samp({y}), 0.0), 4) AS std, round(min({y}), 4) AS min,
  round(quantile_cont({y}, 0.25), 4) AS q25, round(quantile_cont({y}, 0.5), 4) AS median,
  round(quantile_cont({y}, 0.75), 4) AS q75, round(max({y}), 4) AS max"""


@query("numeric_label_summary", W("ev stays", f"""
SELECT segment, {_SUMMARY.format(y='greatest(los_days - 1.0, 0.0)')} FROM stays GROUP BY segment"""))
def numeric_label_summary(spark, sf):
    s = A.stays(spark, sf)
    rows = s.select("segment", F.greatest(F.col("los_days") - 1.0, F.lit(0.0)).alias("label"))
    return L.numeric_summary(rows, ["segment"])


@query("price_summary", f"""
SELECT l_returnflag AS flag, {_SUMMARY.format(y='l_extendedprice')} FROM lineitem GROUP BY 1""")
def price_summary(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return L.numeric_summary(
        li.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("label")), ["flag"]
    )


@query("label_task_types", W(_LAB, """
SELECT 'aki_kdigo' AS task, count(DISTINCT aki_kdigo) AS n_distinct, 'binary' AS task_type FROM labels3
UNION ALL SELECT 'los_remaining', count(DISTINCT los_remaining), 'regression' FROM labels3
UNION ALL SELECT 'mortality_hospital', count(DISTINCT mortality_hospital), 'binary' FROM labels3"""))
def label_task_types(spark, sf):
    return L.infer_task_type(
        all_labels(spark, sf), ["aki_kdigo", "los_remaining", "mortality_hospital"]
    )


@query("multilabel_prevalence", """
SELECT 'quality' AS label_name, count(quality) AS n, count(*) FILTER (quality = 1) AS n_positive,
  round(avg(quality), 6) AS prevalence FROM labels
UNION ALL SELECT 'toxic', count(toxic), count(*) FILTER (toxic = 1), round(avg(toxic), 6) FROM labels""")
def multilabel_prevalence(spark, sf):
    return r6(L.multilabel_prevalence(A.table(spark, sf, "labels"), ["quality", "toxic"]), "prevalence")


@query("missing_label_filter", W(_LAB, """
SELECT count(*) AS total, count(*) - count(aki_kdigo) AS excluded,
  round((count(*) - count(aki_kdigo)) * 100.0 / count(*), 6) AS excluded_pct FROM labels3"""))
def missing_label_filter(spark, sf):
    return r6(CO.label_coverage(all_labels(spark, sf), "aki_kdigo"), "excluded_pct")


@query("removed_samples", W(_LAB, """
SELECT stay_id, 'missing_mortality_hospital_label' AS reason FROM labels3 WHERE mortality_hospital IS NULL"""))
def removed_samples(spark, sf):
    return CO.removed_samples(all_labels(spark, sf), "mortality_hospital")


@query("labels_onto_stays", W(_AKI + " stays", """
SELECT s.stay_id, a.label FROM stays s LEFT JOIN (SELECT * FROM aki WHERE label IS NOT NULL) a USING (stay_id)"""))
def labels_onto_stays(spark, sf):
    src = A.label_sources(spark, sf)
    known = L.build_aki(A.AKI, src).filter("label is not null")
    return L.labels_onto_stays(src["stays"], known)


@query("horizon_check", W("ev", """
SELECT t.task, t.needed, (SELECT CAST(max(hour) + 1 AS INTEGER) FROM ev) AS available,
  (SELECT max(hour) + 1 FROM ev) >= t.needed AS enough
FROM (VALUES ('aki_kdigo', 168), ('long', 200), ('los_remaining', 0)) t(task, needed)"""))
def horizon_check(spark, sf):
    longer = TaskConfig("long", "aki", observation_hours=100, prediction_hours=100)
    return L.horizon_check(A.creatinine(spark, sf), [A.AKI, longer, A.LOS])


# --- splits --------------------------------------------------------------------------------------------------------

CTES["split"] = f"""
SELECT patient_id, CASE WHEN rk < floor(n * 0.7) THEN 'train' WHEN rk < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
FROM (SELECT patient_id, row_number() OVER (ORDER BY {DRAW(42, 'patient_id')}, patient_id) - 1 AS rk, count(*) OVER () AS n
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS patient_id FROM ev))"""


def patient_split(spark, sf):
    people = A.raw_events(spark, sf).select(F.col("user_id").alias("patient_id"))
    return S.split_patients(people)


def split_stays(spark, sf):
    return S.assign_split(A.stays(spark, sf), patient_split(spark, sf), strict=False)


@query("patient_split", W("ev split", "SELECT patient_id, split FROM split"))
def patient_split_query(spark, sf):
    return patient_split(spark, sf)


@query("stay_split", W("ev stays split", "SELECT stay_id, patient_id, split FROM stays LEFT JOIN split USING (patient_id)"))
def stay_split(spark, sf):
    return split_stays(spark, sf).select("stay_id", "patient_id", "split")


@query("split_summary", W("ev stays split", """
SELECT split, count(*) AS n_stays, count(DISTINCT patient_id) AS n_patients,
  round(count(*) / sum(count(*)) OVER (), 6) AS stay_share FROM stays JOIN split USING (patient_id) GROUP BY split"""))
def split_summary(spark, sf):
    return r6(S.split_summary(split_stays(spark, sf)), "stay_share")


@query("patient_is_stay", W("ev stays", """
SELECT count(*) AS n_stays, bool_and(patient_id = CAST(stay_id AS VARCHAR)) AS patient_equals_stay FROM stays"""))
def patient_is_stay(spark, sf):
    return S.patient_is_stay(A.stays(spark, sf))


@query("task_split", W(_LAB + " split", """
SELECT split, aki_kdigo IS NOT NULL AS in_task, count(*) AS n FROM stays JOIN split USING (patient_id)
JOIN labels3 USING (stay_id) GROUP BY ALL"""))
def task_split(spark, sf):
    out = S.task_split(split_stays(spark, sf), all_labels(spark, sf), "aki_kdigo")
    return out.groupBy("split", "in_task").agg(F.count(F.lit(1)).alias("n"))


CTES["subset"] = f"""
SELECT stay_id, rk < greatest(1, floor(n * 0.25)) AS in_subset FROM (SELECT stay_id,
  row_number() OVER (ORDER BY {DRAW(42, 'stay_id')}, stay_id) - 1 AS rk, count(*) OVER () AS n
  FROM stays JOIN split USING (patient_id) WHERE split = 'train')"""


def train_subset(spark, sf):
    train = split_stays(spark, sf).filter("split = 'train'").select("stay_id")
    return S.label_fraction(train, 0.25)


@query("label_fraction", W("ev stays split subset", "SELECT stay_id, in_subset FROM subset"))
def label_fraction(spark, sf):
    return train_subset(spark, sf)


@query("split_record", W("ev stays split subset", """
SELECT patient_id, stay_id, split, in_subset, 42 AS seed, 0.7::DOUBLE AS train_ratio
FROM stays JOIN split USING (patient_id) LEFT JOIN subset USING (stay_id)"""))
def split_record(spark, sf):
    marked = split_stays(spark, sf).join(train_subset(spark, sf), "stay_id", "left")
    rec = S.split_record(marked, 42)
    return rec.withColumn("train_ratio", F.col("ratios")[0]).drop("ratios")


@query("cached_split_check", W("ev stays", """
SELECT true AS same_settings, 0::BIGINT AS n_in_two_splits, count(*) - count(*) FILTER (keep) AS n_unsplit_patients, 0::BIGINT AS n_gone_patients,
  count(*) FILTER (keep AND seg = 0) AS n_train, count(*) FILTER (keep AND seg = 1) AS n_val,
  count(*) FILTER (keep AND seg = 2) AS n_test, count(*) = count(*) FILTER (keep) AS reusable
FROM (SELECT DISTINCT patient_id, CAST(patient_id AS BIGINT) % 3 AS seg, nation <> 4 AS keep FROM stays)"""))
def cached_split_check(spark, sf):
    s = A.stays(spark, sf)
    seg = F.col("patient_id").cast("bigint") % 3
    old = s.filter("nation <> 4").withColumn(
        "split", F.when(seg == 0, "train").when(seg == 1, "val").otherwise("test")
    )
    return S.cached_split_check(S.split_record(old, 42), s, 42)


@query("train_label_support", W(_AKI + " stays split subset", """
SELECT count(label) AS full_train_total, count(*) FILTER (label = 1) AS full_train_positive, count(*) FILTER (label = 0) AS full_train_negative,
  round(count(*) FILTER (label = 1) / count(label), 6) AS full_train_prevalence,
  count(label) FILTER (in_subset) AS train_subset_total, count(*) FILTER (in_subset AND label = 1) AS train_subset_positive,
  count(*) FILTER (in_subset AND label = 0) AS train_subset_negative,
  round(count(*) FILTER (in_subset AND label = 1) / count(label) FILTER (in_subset), 6) AS train_subset_prevalence
FROM subset JOIN aki USING (stay_id)"""))
def train_label_support(spark, sf):
    rows = train_subset(spark, sf).join(L.build_aki(A.AKI, A.label_sources(spark, sf)), "stay_id")
    return r6(L.train_support(rows), "full_train_prevalence", "train_subset_prevalence")


@query("support_gate", W(_AKI + " stays split subset", """
SELECT CASE WHEN count(*) FILTER (in_subset AND label = 1) = 0 OR count(*) FILTER (in_subset AND label = 0) = 0 THEN 'class_lost'
  WHEN count(*) FILTER (in_subset AND label = 1) < 3 THEN 'too_few_positives' ELSE 'ok' END AS status
FROM subset JOIN aki USING (stay_id)"""))
def support_gate(spark, sf):
    rows = train_subset(spark, sf).join(L.build_aki(A.AKI, A.label_sources(spark, sf)), "stay_id")
    return L.support_gate(L.train_support(rows), 0.25)


@query("class_weights", W("pred", """
SELECT status, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
  round(sqrt(count(*) / (2.0 * count(*) FILTER (label = 0))), 6) AS weight_negative,
  round(sqrt(count(*) / (2.0 * count(*) FILTER (label = 1))), 6) AS weight_positive,
  round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 6) AS scale_pos_weight
FROM pred GROUP BY status"""))
def class_weights(spark, sf):
    out = L.class_weights(A.predictions(spark, sf), ["status"])
    return r6(out, "weight_negative", "weight_positive", "scale_pos_weight")


@query("trivial_baselines", W("pred", """
SELECT round(m, 6) AS train_label_mean, round(sd, 6) AS train_label_std, md AS train_label_median,
  round(avg((target - m) ** 2), 6) AS mean_predictor_mse, round(avg(abs(target - md)), 6) AS median_predictor_mae
FROM (SELECT target FROM pred WHERE line > 5),
  (SELECT avg(target) AS m, stddev_pop(target) AS sd, quantile_disc(target, 0.5) AS md FROM pred WHERE line <= 5) GROUP BY m, sd, md"""))
def trivial_baselines(spark, sf):
    p = A.predictions(spark, sf)
    rows = p.select(
        F.col("target").alias("label"), F.when(F.col("line") <= 5, "train").otherwise("test").alias("split")
    )
    return r6(L.trivial_baselines(rows), "train_label_mean", "train_label_std", "mean_predictor_mse",
              "median_predictor_mae")


@query("trivial_binary_baselines", W("pred", """
SELECT round(avg(label) FILTER (line <= 5), 6) AS train_positive_ratio,
  round(CASE WHEN avg(label) FILTER (line <= 5) >= 0.5 THEN avg(label) FILTER (line > 5) ELSE 1 - avg(label) FILTER (line > 5) END, 6) AS majority_accuracy,
  0.5::DOUBLE AS trivial_auroc FROM pred"""))
def trivial_binary_baselines(spark, sf):
    p = A.predictions(spark, sf)
    rows = p.withColumn("split", F.when(F.col("line") <= 5, "train").otherwise("test"))
    return r6(L.trivial_binary_baselines(rows), "train_positive_ratio", "majority_accuracy")


@query("split_label_analysis", W(_AKI + " stays split", """
SELECT split, count(*) AS total_stays, count(label) AS non_null_labels, count(*) - count(label) AS null_labels,
  round((count(*) - count(label)) * 100.0 / count(*), 6) AS null_percentage,
  count(*) FILTER (label = 1) AS positive_labels, count(*) FILTER (label = 0) AS negative_labels,
  round(count(*) FILTER (label = 1) / nullif(count(label), 0), 6) AS positive_prevalence
FROM stays JOIN split USING (patient_id) JOIN aki USING (stay_id) GROUP BY split"""))
def split_label_analysis(spark, sf):
    rows = split_stays(spark, sf).join(L.build_aki(A.AKI, A.label_sources(spark, sf)), "stay_id")
    return r6(L.quality_stats(rows, ["split"]), "null_percentage", "positive_prevalence")


# --- gates on stays and labels -------------------------------------------------------------------------------------

@query("stay_issues", """
SELECT 0::BIGINT AS n_null_patient, sum(n) - count(*) AS n_duplicate_stay, sum(bad) AS n_invalid_los FROM (
SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (value > 300))::BIGINT AS bad FROM events GROUP BY user_id)
""".replace("sum(n)", "CAST(sum(n) AS BIGINT)").replace("sum(bad)", "CAST(sum(bad) AS BIGINT)"))
def stay_issues(spark, sf):
    e = A.table(spark, sf, "events")
    as_stays = e.select(
        F.col("user_id").alias("stay_id"), F.col("user_id").cast("string").alias("patient_id"),
        F.when(F.col("value") > 300, -1.0).otherwise(F.col("value")).alias("los_days"),
    )
    return G.stay_issues(as_stays)


@query("uncovered_stays", W("ev stays", """
SELECT stay_id FROM stays WHERE stay_id NOT IN (SELECT stay_id FROM ev WHERE hour < 24)"""))
def uncovered_stays(spark, sf):
    return G.uncovered_stays(A.stays(spark, sf), CO.valid_hours(A.raw_events(spark, sf), 24))


@query("label_coverage_issues", W("ev stays", """
SELECT stay_id, 'missing' AS issue FROM stays WHERE stay_id NOT IN (SELECT stay_id FROM ev WHERE label = 'click')
UNION ALL SELECT DISTINCT -stay_id, 'extra' FROM ev WHERE label = 'click' AND stay_id % 10 = 3"""))
def label_coverage_issues(spark, sf):
    clicked = A.raw_events(spark, sf).filter("label = 'click'").select("stay_id").distinct()
    odd = clicked.filter("stay_id % 10 = 3").select((-F.col("stay_id")).alias("stay_id"))
    return G.label_coverage_issues(A.stays(spark, sf), clicked.unionByName(odd))


@query("excessive_missing_labels", W(_LAB, """
SELECT 'mortality_hospital' AS task, round((count(*) - count(mortality_hospital)) * 100.0 / count(*), 6) AS null_pct,
  1.0::DOUBLE AS limit_pct FROM labels3 HAVING (count(*) - count(mortality_hospital)) * 100.0 / count(*) > 1.0"""))
def excessive_missing_labels(spark, sf):
    out = G.excessive_missing(all_labels(spark, sf), {"mortality_hospital": 1.0, "los_remaining": 50.0})
    return r6(out, "null_pct")


@query("label_domain", """
SELECT 0::BIGINT AS n_not_finite, count(*) FILTER (l_quantity / 2 <> floor(l_quantity / 2)) AS n_fractional,
  count(*) FILTER (l_quantity / 2 >= 10) AS n_out_of_range FROM lineitem""")
def label_domain(spark, sf):
    li = A.table(spark, sf, "lineitem").select((F.col("l_quantity") / 2).alias("label"))
    return G.label_domain(li, 10)


# --- two datasets ---------------------------------------------------------------------------------------------------

def _two_sides(spark, sf):
    s = A.stays(spark, sf).select("stay_id", "patient_id", "age", "los_days", "nation")
    a = s.filter("nation < 12").drop("nation")
    b = s.filter("nation >= 12").drop("nation").withColumn("age", F.col("age").cast("int"))
    return a, b


@query("combined_static", W("ev stays", """
SELECT stay_id, 'miiv:' || patient_id AS patient_id, CAST(age AS VARCHAR) AS age, 'miiv' AS source_dataset FROM stays WHERE nation < 12
UNION ALL SELECT stay_id, 'eicu:' || patient_id, CAST(CAST(trunc(age) AS INTEGER) AS VARCHAR), 'eicu' FROM stays WHERE nation >= 12"""))
def combined_static(spark, sf):
    a, b = _two_sides(spark, sf)
    series = A.creatinine(spark, sf)
    lab = all_labels(spark, sf)

    def side(s):
        keep = s.select("stay_id")
        return {"static": s, "timeseries": CO.only_stays(series, keep), "labels": CO.only_stays(lab, keep)}

    out = U.combine(side(a), side(b), ("miiv", "eicu"))
    return out["static"].select("stay_id", "patient_id", "age", "source_dataset")


@query("combined_offset", W("ev stays", """
SELECT stay_id, 'a:' || patient_id AS patient_id, 'a' AS source_dataset FROM stays
UNION ALL SELECT stay_id + 100000000, 'b:' || patient_id, 'b' FROM stays WHERE segment = 'BUILDING'"""))
def combined_offset(spark, sf):
    s = A.stays(spark, sf).select("stay_id", "patient_id", "segment")
    b = s.filter("segment = 'BUILDING'")
    if U.ids_collide(s, b):
        b = U.offset_stays(b)
    sides = [U.tagged(U.namespaced_patients(x, n), n) for x, n in ((s, "a"), (b, "b"))]
    return sides[0].unionByName(sides[1]).drop("segment")


@query("merged_labels", W(_LAB, """
SELECT stay_id, aki_kdigo, mortality_hospital FROM (
 SELECT s.stay_id, aki_kdigo, CAST(NULL AS INTEGER) AS mortality_hospital FROM stays s JOIN labels3 USING (stay_id) WHERE nation < 12
 UNION ALL SELECT s.stay_id, NULL, mortality_hospital FROM stays s JOIN labels3 USING (stay_id) WHERE nation >= 12)"""))
def merged_labels(spark, sf):
    a, b = _two_sides(spark, sf)
    lab = all_labels(spark, sf)
    la = CO.only_stays(lab, a).select("stay_id", "aki_kdigo")
    lb = CO.only_stays(lab, b).select("stay_id", "mortality_hospital")
    return U.merged_labels(la, lb)


@query("null_aware_concat", W("ev stays", """
SELECT stay_id, round(los_days, 6) AS los_days, CAST(NULL AS VARCHAR) AS note FROM stays WHERE nation < 12
UNION ALL SELECT stay_id, NULL, segment FROM stays WHERE nation >= 12"""))
def null_aware_concat(spark, sf):
    s = A.stays(spark, sf)
    a = s.filter("nation < 12").select("stay_id", F.round("los_days", 6).alias("los_days"), F.lit(None).alias("note"))
    b = s.filter("nation >= 12").select("stay_id", F.col("segment").alias("note"))
    return U.concat_frames([a, b])


@query("task_sets", """
WITH a AS (SELECT DISTINCT p_type AS task FROM part WHERE p_size < 3),
b AS (SELECT DISTINCT p_type AS task FROM part WHERE p_brand = 'Brand#2' AND p_size > 40)
SELECT task, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT task, 'a' FROM (FROM a EXCEPT FROM b)
UNION ALL SELECT task, 'b' FROM (FROM b EXCEPT FROM a)""")
def task_sets(spark, sf):
    p = A.table(spark, sf, "part").withColumnRenamed("p_type", "task")
    a = p.filter("p_size < 3").select("task").distinct()
    b = p.filter("p_brand = 'Brand#2' and p_size > 40").select("task").distinct()
    return U.task_sets(a, b)


@query("feature_mismatch", """
WITH a AS (SELECT row_number() OVER (ORDER BY n) - 1 AS position, n AS feature FROM (SELECT DISTINCT p_type AS n FROM part)),
b AS (SELECT row_number() OVER (ORDER BY n DESC) - 1 AS position, n AS feature FROM (SELECT DISTINCT p_type AS n FROM part WHERE p_type <> 'LARGE'))
SELECT position, a.feature AS feature_a, b.feature AS feature_b FROM a FULL JOIN b USING (position)
WHERE a.feature IS DISTINCT FROM b.feature""")
def feature_mismatch(spark, sf):
    names = A.table(spark, sf, "part").select(F.col("p_type").alias("feature")).distinct()

    def numbered(df, descending):  # the vocabulary: a handful of feature names
        ordered = F.sort_array(F.collect_list("feature"), not descending)
        return df.agg(ordered.alias("f")).select(F.posexplode("f").alias("position", "feature")) \
            .withColumn("position", F.col("position").cast("bigint"))

    return G.feature_mismatch(numbered(names, False), numbered(names.filter("feature <> 'LARGE'"), True))


# --- gates before combining ------------------------------------------------------------------------

_PRIO = """p AS (SELECT o_orderpriority AS task, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1),
ma AS (SELECT task, CAST(n % 2 AS VARCHAR) AS builder_version, md5(task) AS config_hash FROM p WHERE task <> '5-LOW'),
mb AS (SELECT task, CAST(c % 2 AS VARCHAR) AS builder_version, CASE WHEN task LIKE '2%' THEN 'x' ELSE md5(task) END AS config_hash FROM p WHERE task NOT LIKE '4%')"""
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _manifests(spark, sf):
    """Two label manifests made of the orders' priorities."""
    o = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c")
    )
    a = o.filter("task <> '5-LOW'").select("task", (F.col("n") % 2).cast("string").alias("builder_version"), F.md5("task").alias("config_hash"))
    b = o.filter("task NOT LIKE '4%'").select(
        "task", (F.col("c") % 2).cast("string").alias("builder_version"),
        F.when(F.col("task").like("2%"), "x").otherwise(F.md5("task")).alias("config_hash"),
    )
    return a, b


@query("task_coverage", f"""WITH {_PRIO}
SELECT t.task, ma.task IS NOT NULL AS in_a, mb.task IS NOT NULL AS in_b,
  coalesce(ma.builder_version = mb.builder_version AND ma.config_hash = mb.config_hash, false) AS agree
FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) t(task) LEFT JOIN ma USING (task) LEFT JOIN mb USING (task)""")
def task_coverage(spark, sf):
    return G.task_coverage(*_manifests(spark, sf), PRIORITIES)


@query("task_agreement", f"""WITH {_PRIO}
SELECT task, CASE WHEN mb.config_hash IS NULL THEN 'only in a' WHEN ma.config_hash IS NULL THEN 'only in b'
  WHEN ma.builder_version <> mb.builder_version THEN 'another builder version' WHEN ma.config_hash <> mb.config_hash THEN 'another settings hash' END AS issue
FROM ma FULL JOIN mb USING (task)""")
def task_agreement(spark, sf):
    return G.task_agreement(*_manifests(spark, sf))


@query("invariant_mismatch", """
WITH a AS (SELECT r_name AS invariant, CAST(count(*) AS VARCHAR) AS value FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1),
b AS (SELECT r_name AS invariant, CAST(count(*) AS VARCHAR) AS value FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 20 AND r_name <> 'ASIA' GROUP BY 1)
SELECT invariant, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b USING (invariant) WHERE a.value IS DISTINCT FROM b.value""")
def invariant_mismatch(spark, sf):
    both = A.table(spark, sf, "region").join(A.table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))

    def side(df):
        return df.groupBy(F.col("r_name").alias("invariant")).agg(F.count(F.lit(1)).cast("string").alias("value"))

    return G.invariant_mismatch(side(both), side(both.filter("n_nationkey < 20 AND r_name <> 'ASIA'")))


@query("combine_findings", f"""WITH {_PRIO},
f AS (SELECT list_sort(list(DISTINCT event_type)) AS fa, list_sort(list(DISTINCT event_type) FILTER (event_type <> 'view')) AS fb, CAST(max(user_id) AS VARCHAR) AS ia,
  CAST(min(user_id) AS VARCHAR) AS ib FROM events)
SELECT 'features' AS "check", 'both' AS side, 'only a: view; only b: ' AS detail FROM f WHERE fa <> fb
UNION ALL SELECT 'invariant', 'both', 'seq_length_hours: ' || ia || ' and ' || ib FROM f WHERE ia <> ib
UNION ALL SELECT 'tasks', 'x', 'lacks 5-LOW' UNION ALL SELECT 'label_manifest', 'x', 'lacks 5-LOW'
UNION ALL SELECT 'label_manifest', 'y', 'lacks 4-NOT SPECIFIED' UNION ALL SELECT 'label_columns', 'y', 'labels lack [''3-MEDIUM'']'
UNION ALL SELECT 'manifest_entry', 'both', task || ': ' || CASE WHEN mb.config_hash IS NULL THEN 'only in a' WHEN ma.config_hash IS NULL THEN 'only in b'
  WHEN ma.builder_version <> mb.builder_version THEN 'another builder version' ELSE 'another settings hash' END
FROM ma FULL JOIN mb USING (task) WHERE (ma.builder_version, ma.config_hash) IS DISTINCT FROM (mb.builder_version, mb.config_hash)""")
def combine_findings(spark, sf):
    """Two sides that differ in a feature, a setting, tasks, manifests and label columns."""
    e = A.table(spark, sf, "events")
    ma, mb = _manifests(spark, sf)
    labels = A.table(spark, sf, "orders").select(*[F.lit(1).alias(t) for t in PRIORITIES])

    def meta(cond, number, tasks):
        return e.agg(
            F.sort_array(F.collect_set(F.when(cond, F.col("event_type")))).alias("feature_names"), number.alias("seq_length_hours"),
            F.lit("all").alias("feature_set"), F.lit(48).alias("min_stay_hours"), F.lit(168).alias("label_horizon_hours"),
            F.array(*[F.lit(t) for t in tasks]).alias("tasks"),
        )

    a = {"metadata": meta(F.lit(True), F.max("user_id"), PRIORITIES[:4]), "manifest": ma, "timeseries": e, "labels": labels}
    b = {"metadata": meta(F.col("event_type") != "view", F.min("user_id"), PRIORITIES), "manifest": mb, "timeseries": e, "labels": labels.drop("3-MEDIUM")}
    return G.combine_findings(a, b, ("x", "y"), PRIORITIES)


@query("readiness_findings", W("ev stays", """
SELECT "check", found, wanted FROM (
  SELECT 'static_rows' AS "check", count(*) FILTER (nation < 12) AS found, count(*) AS wanted FROM stays
  UNION ALL SELECT 'timeseries_rows', count(*), (SELECT count(*) FROM stays) FROM (SELECT DISTINCT stay_id, hour FROM ev)
  UNION ALL SELECT 'labels_rows', count(*), count(*) FROM stays
  UNION ALL SELECT 'n_features', count(DISTINCT label), 84 FROM ev
  UNION ALL SELECT 'zero_observation_stays_excluded', 0, 1)
WHERE found <> wanted"""))
def readiness_findings(spark, sf):
    """Stored metadata against the tables: too few features, row counts that differ, no word on empty stays."""
    stays, ev = A.stays(spark, sf), A.raw_events(spark, sf)
    meta = stays.agg(F.count(F.lit(1)).alias("n_stays")).crossJoin(ev.agg(F.collect_set("label").alias("feature_names")))  # two one-row frames
    tables = {"static": stays.filter("nation < 12"), "timeseries": ev.select("stay_id", "hour").distinct(), "labels": stays}
    return G.readiness_findings(meta, tables, "miiv")
