"""Data-quality gates. Each returns a small frame of findings; ``require`` turns them into errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.functions import values as V
from cohortspark.operators.ordering import null_safe_join
from cohortspark.session import stage


class GateError(ValueError):
    """A gate found problems."""


def require(findings: DataFrame, message: str, show: int = 10) -> None:
    """Raise when the frame of findings has rows; the text quotes a few of them."""
    rows = findings.limit(show).collect()
    if rows:
        raise GateError(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


# --- stays, series, labels ----------------------------------------------------------

def stay_issues(stays: DataFrame) -> DataFrame:
    """Counts of null patients, repeated stay ids and invalid stay lengths."""
    per = stays.groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("patient_id").isNull()).alias("no_patient"),
        F.count_if(F.col("los_days").isNull() | F.isnan("los_days") | (F.col("los_days") < 0))
        .alias("bad_los"),
    )
    return per.agg(
        F.coalesce(F.sum("no_patient"), F.lit(0)).alias("n_null_patient"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_stay"),
        F.coalesce(F.sum("bad_los"), F.lit(0)).alias("n_invalid_los"),
    )


def check_stays(stays: DataFrame) -> None:
    bad = "n_null_patient + n_duplicate_stay + n_invalid_los > 0"
    require(stay_issues(stays).filter(bad), "invalid stays")


def uncovered_stays(stays: DataFrame, series: DataFrame) -> DataFrame:
    """Stays without a row in the series."""
    return stays.select("stay_id").join(series.select("stay_id"), "stay_id", "left_anti")


def missing_features(series: DataFrame, features: Sequence[str]) -> list[str]:
    have = set(series.columns)
    return [c for f in features for c in (f, f"{f}_mask") if c not in have]


def check_series(stays: DataFrame, series: DataFrame, features: Sequence[str]) -> None:
    lost = missing_features(series, features)
    if lost:
        raise GateError(f"series lacks columns {lost}")
    require(uncovered_stays(stays, series), "stays without series")


def label_coverage_issues(stays: DataFrame, labels: DataFrame) -> DataFrame:
    """(stay_id, issue): ``missing`` stays are an error, ``extra`` ones a warning."""
    a, b = stays.select("stay_id"), labels.select("stay_id")
    lost = a.join(b, "stay_id", "left_anti").withColumn("issue", F.lit("missing"))
    more = b.join(a, "stay_id", "left_anti").withColumn("issue", F.lit("extra"))
    return lost.unionByName(more)


def excessive_missing(labels: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(task, null_pct, limit) of tasks above their allowed share of missing labels."""
    if not limits:
        return labels.sparkSession.createDataFrame([], "task string, null_pct double, limit_pct double")
    n = F.count(F.lit(1))
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("task"),
                ((n - F.count(t)) * 100.0 / n).alias("null_pct"),
                F.lit(float(limit)).alias("limit_pct"),
            )
            for t, limit in limits.items()
        ]
    )
    rows = labels.agg(cells.alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")
    return rows.filter(F.col("null_pct") > F.col("limit_pct"))


def label_domain(df: DataFrame, n_classes: int, label: str = "label") -> DataFrame:
    """Counts of labels that are infinite, fractional, or outside ``[0, n_classes)``."""
    y = F.col(label).cast("double")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf")))
    return df.agg(
        F.count_if(y.isNotNull() & ~finite).alias("n_not_finite"),
        F.count_if(finite & (y != F.floor(y))).alias("n_fractional"),
        F.count_if(finite & ((y < 0) | (y >= n_classes))).alias("n_out_of_range"),
    )


# --- dataset compatibility -------------------------------------------------------------

def feature_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions whose feature differs; input (position, feature)."""
    left = a.select("position", F.col("feature").alias("feature_a"))
    right = b.select("position", F.col("feature").alias("feature_b"))
    return left.join(right, "position", "full").filter(
        ~F.col("feature_a").eqNullSafe(F.col("feature_b"))
    )


def invariant_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Named settings that differ; input (invariant, value)."""
    left = a.select("invariant", F.col("value").alias("value_a"))
    right = b.select("invariant", F.col("value").alias("value_b"))
    return left.join(right, "invariant", "full").filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that differ in position, name or type."""
    out = []
    if a.columns != b.columns:
        out.append(f"columns {a.columns} != {b.columns}")
    types = dict(b.dtypes)
    out += [f"{n}: {t} != {types[n]}" for n, t in a.dtypes if n in types and types[n] != t]
    return out


def task_coverage(tasks_a: DataFrame, tasks_b: DataFrame, required: Sequence[str]) -> DataFrame:
    """(task, in_a, in_b, agree) for every required task; manifests agree on version and hash."""
    need = tasks_a.sparkSession.createDataFrame([(t,) for t in required], "task string")
    a = tasks_a.select("task", F.struct("builder_version", "config_hash").alias("a"))
    b = tasks_b.select("task", F.struct("builder_version", "config_hash").alias("b"))
    return need.join(a, "task", "left").join(b, "task", "left").select(
        "task", F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"),
        F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("agree"),
    )


def manifest_issues(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Tasks whose stored labels are stale: absent, or another version or settings hash."""
    old = saved.select("task", F.struct("builder_version", "config_hash").alias("old"))
    new = current.select("task", F.struct("builder_version", "config_hash").alias("new"))
    reason = F.when(F.col("old").isNull(), "not_extracted").when(F.col("old") != F.col("new"), "stale")
    return new.join(old, "task", "left").select("task", reason.alias("issue")).filter("issue is not null")


def benchmark_metadata_issues(meta: dict, features: Sequence[str]) -> list[str]:
    """Deviations of stored metadata from the fixed benchmark settings."""
    want = {
        "seq_length_hours": C.SEQ_LENGTH_HOURS, "min_stay_hours": C.MIN_STAY_HOURS,
        "label_horizon_hours": C.LABEL_HORIZON_HOURS,
    }
    out = [f"{k}: {meta.get(k)!r} instead of {v!r}" for k, v in want.items() if meta.get(k) != v]
    blocked = sorted(set(features) & set(C.BLOCKED_FEATURES))
    if blocked:
        out.append(f"blocked features present: {blocked}")
    lost = sorted(set(C.BENCHMARK_TASKS) - set(meta.get("tasks", ())))
    if lost:
        out.append(f"tasks missing: {lost}")
    return out


def artifact_readiness(
    static: DataFrame, series: DataFrame, labels: DataFrame, n_features: int, expected: int = 84
) -> DataFrame:
    """Row counts of the three tables, the feature count, zero-observation stays, and a verdict."""
    seen = F.exists("mask", lambda r: F.exists(r, lambda x: x))
    counts = (
        static.agg(F.count(F.lit(1)).alias("n_static"))
        .crossJoin(series.agg(F.count(F.lit(1)).alias("n_series"), F.count_if(~seen).alias("n_unobserved")))
        .crossJoin(labels.agg(F.count(F.lit(1)).alias("n_labels")))
    )  # three one-row frames
    ready = (
        (F.col("n_static") == F.col("n_series")) & (F.col("n_static") == F.col("n_labels"))
        & (F.col("n_unobserved") == 0) & (F.lit(n_features) == expected)
    )
    return counts.withColumn("n_features", F.lit(n_features)).withColumn("ready", ready)


INVARIANTS = ("feature_set", "seq_length_hours", "min_stay_hours", "label_horizon_hours")


def combine_findings(
    a: dict[str, DataFrame], b: dict[str, DataFrame], names: tuple[str, str], required: Sequence[str] = C.BENCHMARK_TASKS,
) -> DataFrame:
    """(check, side, detail) for all that forbids combining two processed datasets; no rows mean they may be.

    Each side has ``metadata`` (one row), ``manifest`` (a row per task), ``timeseries`` and ``labels``. What the
    metadata do not say counts as a finding. All constraints are one table over the two metadata rows and the two short manifests;
    no row of the data is read.
    """
    from pyspark.sql import types as T

    spark = a["labels"].sparkSession
    facts = []
    for side, name in ((a, names[0]), (b, names[1])):
        meta, manifest = side.get("metadata"), side.get("manifest")
        if meta is None:
            facts.append(("metadata", name, "there is no metadata"))
        if manifest is None:
            facts.append(("label_manifest", name, "there is no label manifest"))
        lost = sorted(set(required) - set(side["labels"].columns))
        if lost:
            facts.append(("label_columns", name, f"labels lack {lost}"))
    facts += [("series_schema", "both", d) for d in schema_differences(a["timeseries"], b["timeseries"])]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("check", "side", "detail")])
    out = [spark.createDataFrame(facts, schema)]
    if all(side.get(k) is not None for side in (a, b) for k in ("metadata", "manifest")):
        out += _metadata_findings(a, b, names, required)
    return reduce(DataFrame.unionByName, out)


def _metadata_findings(a, b, names, required) -> list[DataFrame]:
    def row(side: dict[str, DataFrame], end: str) -> DataFrame:
        meta = side["metadata"]
        values = [
            (F.col(c).cast("string") if c in meta.columns else F.lit(None).cast("string")).alias(f"{c}_{end}") for c in INVARIANTS
        ]
        lists = [
            (F.col(c).cast("array<string>") if c in meta.columns else F.lit(None).cast("array<string>")).alias(f"{c}_{end}")
            for c in ("feature_names", "tasks")
        ]
        return meta.limit(1).select(*values, *lists).crossJoin(  # one row each
            side["manifest"].agg(F.collect_set("task").alias(f"manifest_{end}"))  # a name per task
        )

    both = row(a, "a").crossJoin(row(b, "b"))  # two one-row frames
    fa, fb = F.col("feature_names_a"), F.col("feature_names_b")
    same_set = F.coalesce((F.size(F.array_except(fa, fb)) == 0) & (F.size(F.array_except(fb, fa)) == 0), F.lit(False))
    need = F.array(*[F.lit(t) for t in required])
    checks = [
        ("feature_order", "both", same_set & (fa != fb), F.lit("the same features in another order")),
        ("features", "both", ~same_set, F.concat_ws(
            "; ", F.concat(F.lit("only a: "), F.array_join(F.sort_array(F.array_except(fa, fb)), ",")),
            F.concat(F.lit("only b: "), F.array_join(F.sort_array(F.array_except(fb, fa)), ",")))),
    ]
    for c in INVARIANTS:
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        checks.append(("invariant", "both", ~x.eqNullSafe(y), F.concat(F.lit(f"{c}: "), F.coalesce(x, F.lit("none")), F.lit(" and "), F.coalesce(y, F.lit("none")))))
    for end, name in (("a", names[0]), ("b", names[1])):
        for check, held in (("tasks", f"tasks_{end}"), ("label_manifest", f"manifest_{end}")):
            lost = F.sort_array(F.array_except(need, F.coalesce(F.col(held), F.array().cast("array<string>"))))
            checks.append((check, name, F.size(lost) > 0, F.concat(F.lit("lacks "), F.array_join(lost, ","))))
    table = F.array(*[
        F.struct(F.lit(k).alias("check"), F.lit(side).alias("side"), F.coalesce(bad, F.lit(True)).alias("bad"), F.coalesce(detail, F.lit("")).alias("detail"))
        for k, side, bad, detail in checks
    ])
    found = both.select(F.explode(F.filter(table, lambda r: r["bad"])).alias("r")).select("r.check", "r.side", "r.detail")
    held = task_agreement(a["manifest"], b["manifest"]).filter("issue is not null")
    return [found, held.select(F.lit("manifest_entry").alias("check"), F.lit("both").alias("side"), F.concat_ws(": ", "task", "issue").alias("detail"))]


def task_agreement(manifest_a: DataFrame, manifest_b: DataFrame) -> DataFrame:
    """(task, issue) of all tasks of two label manifests: only on one side, another version, another settings hash, or null."""
    x, y = (m.select("task", F.struct("builder_version", "config_hash").alias(end)) for m, end in ((manifest_a, "a"), (manifest_b, "b")))
    a, b = F.col("a"), F.col("b")
    issue = (
        F.when(b.isNull(), "only in a").when(a.isNull(), "only in b")
        .when(~a["builder_version"].eqNullSafe(b["builder_version"]), "another builder version")
        .when(~a["config_hash"].eqNullSafe(b["config_hash"]), "another settings hash")
    )
    return x.join(y, "task", "full").select("task", issue.alias("issue"))


def readiness_findings(meta: DataFrame, tables: dict[str, DataFrame], dataset: str, expected: int = 84) -> DataFrame:
    """(check, found, wanted) where stored metadata and the row counts of a processed dataset do not fit; no rows: ready.

    Counts come from one aggregate per table, which Parquet answers from its footers. Metadata that are absent or have no
    feature count are findings; combined datasets need not confirm that empty stays were left out.
    """
    def number(c: str) -> Column:
        return F.col(c).cast("bigint") if c in meta.columns else F.lit(None).cast("bigint")

    features = F.coalesce(number("n_features"), F.size("feature_names").cast("bigint") if "feature_names" in meta.columns else F.lit(0).cast("bigint"))
    excluded = F.col("zero_observation_stays_excluded").cast("boolean") if "zero_observation_stays_excluded" in meta.columns else F.lit(False)
    said = meta.agg(F.count(F.lit(1)).alias("n_meta"), F.max(features).alias("n_features"), F.max(number("n_stays")).alias("n_stays"),
                    F.coalesce(F.bool_and(excluded), F.lit(False)).alias("excluded"))
    row = said
    for name, df in tables.items():
        row = row.crossJoin(df.agg(F.count(F.lit(1)).alias(f"n_{name}_rows")))  # one-row frames
    checks = [("metadata", F.col("n_meta"), F.lit(1)), ("n_features", F.col("n_features"), F.lit(expected))]
    checks += [(f"{name}_rows", F.col(f"n_{name}_rows"), F.coalesce(F.col("n_stays"), F.col(f"n_{name}_rows"))) for name in tables]
    if dataset != "combined":
        checks.append(("zero_observation_stays_excluded", F.col("excluded").cast("bigint"), F.lit(1)))
    table = F.array(*[F.struct(F.lit(k).alias("check"), x.cast("bigint").alias("found"), y.cast("bigint").alias("wanted")) for k, x, y in checks])
    return row.select(F.explode(F.filter(table, lambda r: ~r["found"].eqNullSafe(r["wanted"]))).alias("r")).select("r.*")


# --- run marts ----------------------------------------------------------------------------

def fingerprint_collisions(df: DataFrame, keys=(*C.FINGERPRINT, "seed"), audit=("lr", "mask_ratio")):
    """Keys shared by runs that differ in an audited setting."""
    keys = [k for k in keys if k in df.columns]
    audit = [a for a in audit if a in df.columns]
    variants = df.groupBy(*keys, *audit).agg(F.count(F.lit(1)).alias("n"))
    return variants.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_variants")
    ).filter("n_variants > 1")


def duplicate_fingerprints(df: DataFrame, keys=(*C.FINGERPRINT, "seed")) -> DataFrame:
    keys = [k for k in keys if k in df.columns]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def matrix_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Comparable keys: blank text is null, numbers are rounded to 12 places."""
    types = dict(df.dtypes)
    out = []
    for k in keys:
        c = F.col(k)
        if types[k] in ("double", "float"):
            c = F.round(F.when(~F.isnan(c), c), 12)
        elif types[k] == "string":
            c = F.when(~V.is_blank(c), c)
        out.append(c.alias(k))
    return df.select(*out).distinct()


def matrix_differences(
    observed: DataFrame, expected: DataFrame, keys: Sequence[str] = (*C.FINGERPRINT, "seed")
) -> DataFrame:
    """Keys in one side only, with issue ``missing`` or ``unexpected``."""
    keys = list(keys)
    seen, want = matrix_keys(observed, keys), matrix_keys(expected, keys)
    sides = seen.withColumn("_seen", F.lit(True)).unionByName(want.withColumn("_seen", F.lit(False)))
    per = sides.groupBy(*keys).agg(  # one group per key: each side is read once
        F.bool_or("_seen").alias("_seen"), F.bool_and("_seen").alias("_only")
    )
    issue = F.when(~F.col("_seen"), "missing").when(F.col("_only"), "unexpected")
    return per.select(*keys, issue.alias("issue")).filter("issue is not null")


def null_safe_anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, cond, "left_anti")


def seed_set_issues(
    df: DataFrame, keys: Sequence[str], seeds: Sequence[int] = C.FIXED_SEEDS
) -> DataFrame:
    """Keys whose seeds are not exactly the expected ones."""
    one = df.groupBy(*keys, "seed").agg(F.lit(1).alias("one"))
    good = F.col("seed").isin(*seeds)
    per = one.groupBy(*keys).agg(
        F.count_if(good).alias("n_expected"), F.count_if(~good).alias("n_unexpected")
    )
    return per.withColumn("n_missing", F.lit(len(seeds)) - F.col("n_expected")).filter(
        "n_missing > 0 or n_unexpected > 0"
    )


def is_eval_row() -> Column:
    return F.col("phase").isin(*C.EVAL_PHASES)


def checkpoint_reason() -> Column:
    """First problem of a row's checkpoint provenance, null when there is none."""
    src = F.col("eval_checkpoint_source")
    error = F.when(~V.is_blank("best_ckpt_error"), F.concat(F.lit(": "), "best_ckpt_error"))
    failed = F.concat(F.lit("checkpoint selection failed"), F.coalesce(error, F.lit("")))
    best = src == "best"
    return (
        F.when(V.is_blank(src), "checkpoint source missing")
        .when(src == "failed", failed)
        .when(~src.isin("best", "final"), "checkpoint source not recognised")
        .when(V.is_blank("eval_artifact_sha256"), "artifact digest missing")
        .when(best & V.is_blank("best_ckpt_path"), "best checkpoint path missing")
        .when(best & ~V.is_true_text("best_ckpt_load_ok"), "best checkpoint load not confirmed")
    )


def checkpoint_issues(df: DataFrame) -> DataFrame:
    """Evaluation rows (other than boosted trees) without sound checkpoint provenance."""
    needed = is_eval_row() & (F.lower(F.coalesce("paradigm", F.lit(""))) != "xgboost")
    return df.filter(needed).withColumn("reason", checkpoint_reason()).filter("reason is not null")


def required_fairness_keys() -> Column:
    """Keys a row must have: no race for eicu, error gaps for stay-length tasks."""
    attrs = F.filter(
        F.array(*[F.lit(a) for a in C.PROTECTED_ATTRIBUTES]),
        lambda a: (F.lower(F.coalesce("dataset", F.lit(""))) != "eicu") | (a != "race"),
    )
    names = F.when(
        F.lower(F.coalesce("task", F.lit(""))).startswith("los"),
        F.array(*[F.lit(m) for m in C.REGRESSION_FAIRNESS_KEYS]),
    ).otherwise(F.array(*[F.lit(m) for m in C.BINARY_FAIRNESS_KEYS]))
    return F.flatten(
        F.transform(
            attrs,
            lambda a: F.transform(names, lambda m: F.concat(F.lit("fairness/"), a, F.lit("/"), m)),
        )
    )


def fairness_gaps(df: DataFrame) -> DataFrame:
    """Evaluation rows with the required keys they lack (``fairness_keys`` lists the present)."""
    rows = df.filter(is_eval_row() & ~V.is_blank("task"))
    present = F.coalesce("fairness_keys", F.array().cast("array<string>"))
    lost = F.array_except(required_fairness_keys(), present)
    return V.once(rows, missing_keys=lost).filter(F.size("missing_keys") > 0)


def fairness_staleness(df: DataFrame) -> DataFrame:
    """Evaluation rows whose fairness summary does not belong to the exported model."""
    tree = F.lower(F.coalesce("paradigm", F.lit(""))) == "xgboost"
    src = F.col("eval_checkpoint_source")
    folder = F.col("output_dir")
    want_source = (
        F.when(tree, "xgboost_model").when(src == "best", "recorded_best")
        .when(src == "final", "recorded_final")
    )
    want_ckpt = F.when(tree, "xgboost_model").when(src.isin("best", "final"), src)
    path = (
        F.when(tree, F.when(~V.is_blank(folder), F.concat(folder, F.lit("/xgboost_model.json"))))
        .when(src == "best", F.when(~V.is_blank("best_ckpt_path"), F.col("best_ckpt_path")))
        .when((src == "final") & ~V.is_blank(folder), F.concat(folder, F.lit("/checkpoints/last.ckpt")))
    )
    want_id = F.when(path.isNotNull(), V.artifact_id(path))
    have_id, want_id_at, attrs_at = F.col("_have_id"), F.col("_want_id"), F.col("_attrs")
    sha, want_sha = F.col("fairness_artifact_sha256"), F.col("eval_artifact_sha256")
    wanted = F.array(*[F.lit(a) for a in C.PROTECTED_ATTRIBUTES])
    size = F.col("fairness_min_subgroup_size").try_cast("double").cast("int")

    def differs(have, want):
        return want.isNotNull() & ~have.eqNullSafe(want)

    checks = [
        (~F.col("fairness_summary_schema_version").eqNullSafe(F.lit(C.FAIRNESS_SCHEMA_VERSION)),
         "schema version"),
        (~F.col("fairness_script_version").eqNullSafe(F.lit(C.FAIRNESS_SCRIPT_VERSION)),
         "script version"),
        (~attrs_at.eqNullSafe(wanted), "protected attributes"),
        (~size.eqNullSafe(F.lit(C.MIN_SUBGROUP_PATIENTS)), "minimum subgroup size"),
        (differs(F.col("fairness_artifact_source"), want_source), "artifact source"),
        (differs(F.col("fairness_checkpoint_source"), want_ckpt), "checkpoint source"),
        (have_id == "", "artifact path missing"),
        ((have_id != "") & differs(have_id, want_id_at), "artifact path"),
        (V.is_blank(sha), "artifact digest missing"),
        (~V.is_blank(sha) & ~V.is_blank(want_sha) & (sha != want_sha), "artifact digest"),
        (~V.is_blank(sha) & V.is_blank(want_sha) & want_id_at.isNotNull(), "evaluation digest missing"),
    ]
    found = F.filter(
        F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda m: m.isNotNull()
    )
    rows = V.once(
        df.filter(is_eval_row() & ~V.is_blank("task")), _have_id=V.artifact_id("fairness_artifact_path"), _want_id=want_id,
        _attrs=V.decode_attributes("fairness_protected_attributes"),
    )
    return V.once(rows, issues=found).drop("_have_id", "_want_id", "_attrs").filter(F.size("issues") > 0)


def _has_metric(prefix: str) -> Column:
    return F.exists(F.map_keys("metrics"), lambda k: k.startswith(prefix))


def optional_warnings(df: DataFrame) -> DataFrame:
    """(check, n) of nice-to-have fields: train, validation and compute metrics."""
    no_val_needed = (F.lower(F.coalesce("experiment_class", F.lit(""))) == "classical_baselines") | (
        F.lower(F.coalesce("paradigm", F.lit(""))) == "xgboost"
    )
    compute = F.exists(F.map_keys("metrics"), lambda k: k.isin(*C.COMPUTE_METRICS))
    rows = df.filter(is_eval_row())
    one = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~_has_metric("train/")).alias("no_train"),
        F.count_if(~no_val_needed & ~_has_metric("val/")).alias("no_val"),
        F.count_if(compute).alias("with_compute"),
    )
    cells = F.array(
        F.struct(F.lit("no_train_metrics").alias("check"), F.col("no_train").alias("n")),
        F.struct(F.lit("no_val_metrics").alias("check"), F.col("no_val").alias("n")),
        F.struct(F.lit("no_compute_metrics").alias("check"),
                 F.when(F.col("with_compute") == 0, F.col("n")).otherwise(0).alias("n")),
    )
    return one.select(F.explode(cells).alias("_r")).select("_r.*").filter("n > 0")


def mixed_revisions(df: DataFrame, keys: Sequence[str] = C.FINGERPRINT) -> DataFrame:
    """Aggregated configs whose seeds come from several revisions."""
    keys = [k for k in keys if k in df.columns]
    per = df.filter(F.col("revision").isNotNull()).groupBy(*keys).agg(
        F.count_distinct("revision").alias("n_revisions")
    )
    return per.filter("n_revisions > 1")


def launch_commit_issues(df: DataFrame) -> DataFrame:
    """Per revision: runs without a commit, and the number of distinct commits."""
    revision = F.when(~V.is_blank("revision"), F.trim("revision"))
    commit = F.when(~V.is_blank("launch_commit"), F.trim("launch_commit"))
    per = df.groupBy(revision.alias("revision")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(commit.isNull()).alias("n_without_commit"),
        F.count_distinct(commit).alias("n_commits"),
    )
    issue = (
        F.when(F.col("revision").isNull(), "revision_missing")
        .when(F.col("n_commits") > 1, "mixed_commits")
        .when(F.col("n_without_commit") > 0, "commit_missing")
    )
    return per.withColumn("issue", issue).filter("issue is not null")


def metric_gaps(df: DataFrame) -> DataFrame:
    """Rows without any test metric, and evaluation rows without their primary metric."""
    primary = V.primary_metric("task")
    reason = F.when(~_has_metric("test/"), "no_test_metrics").when(
        is_eval_row() & primary.isNotNull() & F.element_at("metrics", primary).isNull(),
        "no_primary_metric",
    )
    return df.withColumn("reason", reason).filter("reason is not null")


def validate_marts(
    rows: DataFrame, tests: DataFrame | None = None, expected: DataFrame | None = None,
    seeds: Sequence[int] = C.FIXED_SEEDS,
) -> DataFrame:
    """All warnings as (check, n) rows; an export is refused when any counts."""
    rows = stage(rows, "mart")  # every check below reads some columns of it
    keys = [k for k in C.FINGERPRINT if k in rows.columns]
    parts = [
        ("seed_set", seed_set_issues(rows.filter(F.col("experiment_class").isin(*C.EXPERIMENT_CLASSES)), keys, seeds)),
        ("metric_gaps", metric_gaps(rows)),
        ("checkpoint", checkpoint_issues(rows)),
        ("fairness_missing", fairness_gaps(rows)),
        ("fairness_stale", fairness_staleness(rows)),
        ("mixed_revisions", mixed_revisions(rows)),
        ("launch_commits", launch_commit_issues(rows)),
    ]
    if expected is not None:
        parts.append(("matrix", matrix_differences(rows, expected)))
    if tests is not None:
        parts.append(("paired_coverage", tests.filter("n_shared_pairs < n_union_pairs")))
    counted = [
        p.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, p in parts
    ]
    return reduce(DataFrame.unionByName, counted).filter("n > 0")
