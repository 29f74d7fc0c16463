"""Label builders (kidney injury, stay length), their registry and quality numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.config import TaskConfig
from cohortspark.operators.mortality import build_mortality
from cohortspark.operators.ordering import exact_quantiles, null_safe_join

Builder = Callable[[TaskConfig, dict[str, DataFrame]], DataFrame]

BUILDER_VERSIONS = {"mortality": "2.3.0", "aki": "1.1.0", "los": "1.0.0"}


# --- kidney injury -------------------------------------------------------------

def rise_flags(series: DataFrame, task: TaskConfig) -> DataFrame:
    """Per stay: has any value / baseline / later value, and the two rise criteria.

    The absolute criterion asks for a pair of values at most 48 h apart whose later
    one lies in the detection window. Subtraction is monotone, so the smallest value
    of the 48 h before decides: a RANGE window instead of a self-join. Repeated
    rows of an hour first collapse to their extremes, which bounds the rows of one
    stay by the number of hours.
    """
    p = task.params
    value = p.get("creatinine_col", "crea")
    base_h = p.get("baseline_window_hours", C.SEQ_LENGTH_HOURS)
    if not task.prediction_hours:
        raise ValueError("a rise label needs prediction_hours")
    start = task.observation_hours
    end = start + task.prediction_hours
    hours = (
        series.filter(F.col(value).isNotNull())
        .groupBy("stay_id", "hour")
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    )
    back = Window.partitionBy("stay_id").orderBy("hour").rangeBetween(-48, -1)
    seen = hours.withColumn("floor48", F.min("lo").over(back))
    late = (F.col("hour") >= start) & (F.col("hour") < end)
    rel = late & (F.col("hour") < p.get("relative_window_hours", 168))
    per = seen.groupBy("stay_id").agg(
        F.min(F.when(F.col("hour") < base_h, F.col("lo"))).alias("baseline"),
        F.bool_or(late).alias("has_later"),
        F.max(F.when(rel, F.col("hi"))).alias("peak"),
        F.max(F.when(late, F.col("hi") - F.col("floor48"))).alias("rise48"),
    )
    return per.select(
        "stay_id",
        F.col("baseline").isNotNull().alias("has_baseline"),
        "has_later",
        (F.col("peak") >= F.col("baseline") * p.get("relative_rise_threshold", 1.5)).alias("relative"),
        (F.col("rise48") >= p.get("absolute_rise_threshold", 0.3)).alias("absolute"),
    )


def aki_with_reasons(task: TaskConfig, sources: dict[str, DataFrame]) -> DataFrame:
    """(stay_id, label, null_reason)."""
    stays, series = sources["stays"].select("stay_id"), sources["timeseries"]
    if task.params.get("creatinine_col", "crea") not in series.columns:
        return stays.select(
            "stay_id", F.lit(None).cast("int").alias("label"),
            F.lit("no_creatinine_or_baseline").alias("null_reason"),
        )
    flags = stays.join(rise_flags(series, task), "stay_id", "left")
    has_base = F.coalesce(F.col("has_baseline"), F.lit(False))
    reason = (
        F.when(~has_base, "no_creatinine_or_baseline")
        .when(~F.col("has_later"), "no_post_obs_creatinine")
    )
    hit = F.coalesce(F.col("relative"), F.lit(False)) | F.coalesce(F.col("absolute"), F.lit(False))
    return flags.select(
        "stay_id",
        F.when(reason.isNull(), hit.cast("int")).alias("label"),
        reason.alias("null_reason"),
    )


def build_aki(task: TaskConfig, sources: dict[str, DataFrame]) -> DataFrame:
    return aki_with_reasons(task, sources).select("stay_id", "label")


# --- stay length -----------------------------------------------------------------

def build_los(task: TaskConfig, sources: dict[str, DataFrame]) -> DataFrame:
    """Days left after the observation, not below zero; null stays null."""
    los = F.col("los_days")
    left = los - F.lit((task.observation_hours or 0) / 24.0)
    return sources["stays"].select(
        "stay_id", F.when(los.isNotNull(), F.greatest(left, F.lit(0.0))).alias("label")
    )


# --- registry and orchestration ------------------------------------------------------

BUILDERS: dict[str, Builder] = {
    "mortality": build_mortality, "aki": build_aki, "los": build_los,
}


def register_label(category: str, builder: Builder) -> None:
    BUILDERS[category] = builder


def builder_for(task: TaskConfig) -> Builder:
    """By category, else by the longest registered prefix of the task name."""
    if task.category in BUILDERS:
        return BUILDERS[task.category]
    hits = [c for c in BUILDERS if task.name.startswith(c)]
    if not hits:
        raise ValueError(f"no label builder for task {task.name!r}; known: {sorted(BUILDERS)}")
    return BUILDERS[max(hits, key=len)]


def check_sources(task: TaskConfig, sources: dict[str, DataFrame]) -> None:
    missing = sorted(set(task.sources) - set(sources))
    if missing:
        raise ValueError(f"task {task.name!r} needs sources {missing}")


def labels_onto_stays(stays: DataFrame, labels: DataFrame) -> DataFrame:
    return stays.select("stay_id").join(labels, "stay_id", "left")


def extract_labels(
    tasks: Sequence[TaskConfig], sources: dict[str, DataFrame], dataset: str | None = None,
    seq_length: int | None = None,
) -> DataFrame:
    """One row per stay, one column per task; tasks that exclude the dataset are skipped."""
    out = sources["stays"].select("stay_id")
    for task in tasks:
        if task.datasets and dataset is not None and dataset not in task.datasets:
            continue
        obs = task.observation_hours
        if seq_length is not None and obs is not None and obs != seq_length:
            raise ValueError(f"task {task.name!r} observes {obs} h, the series has {seq_length} h")
        check_sources(task, sources)
        built = builder_for(task)(task, sources).withColumnRenamed("label", task.name)
        out = out.join(built, "stay_id", "left")
    return out


def required_horizon(task: TaskConfig) -> int:
    """Hours of raw series the labels of the task need."""
    if task.category == "aki":
        if task.prediction_hours is None:
            raise ValueError("a rise label needs prediction_hours")
        return int((task.observation_hours or C.SEQ_LENGTH_HOURS) + task.prediction_hours)
    return int(task.observation_hours or 0) if "timeseries" in task.sources else 0


def horizon_check(series: DataFrame, tasks: Sequence[TaskConfig], exported: int | None = None):
    """Per task: hours needed, hours there, and whether that is enough."""
    need = F.explode(
        F.array(
            *[
                F.struct(F.lit(t.name).alias("task"), F.lit(required_horizon(t)).alias("needed"))
                for t in tasks
            ]
        )
    )
    have = F.max("hour") + 1 if exported is None else F.lit(exported)
    one = series.agg(have.cast("int").alias("available"))
    rows = one.select("available", need.alias("_t"))
    return rows.select(
        "_t.task", "_t.needed", "available",
        (F.col("available") >= F.col("_t.needed")).alias("enough"),
    )


def label_manifest(spark, tasks: Sequence[TaskConfig]) -> DataFrame:
    """Task settings to store beside the labels."""
    rows = [
        (t.name, t.category, BUILDER_VERSIONS.get(t.category, "1.0.0"), t.config_hash(),
         list(t.sources), list(t.datasets))
        for t in tasks
    ]
    schema = (
        "task string, category string, builder_version string, config_hash string, "
        "sources array<string>, datasets array<string>"
    )
    return spark.createDataFrame(rows, schema)


# --- quality numbers -------------------------------------------------------------------

def quality_stats(labels: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Counts, null share and prevalence among the labelled, optionally per group."""
    y, n = F.col(label), F.count(F.lit(1))
    pos, known = F.count_if(y == 1), F.count(y)
    return labels.groupBy(*by).agg(
        n.alias("total_stays"),
        known.alias("non_null_labels"),
        (n - known).alias("null_labels"),
        F.when(n > 0, (n - known) * 100.0 / n).otherwise(0.0).alias("null_percentage"),
        pos.alias("positive_labels"),
        F.count_if(y == 0).alias("negative_labels"),
        F.when(known > 0, pos / known).alias("positive_prevalence"),
    )


def null_reasons(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count_if(F.col("null_reason") == "no_creatinine_or_baseline").alias(
            "no_creatinine_or_baseline"
        ),
        F.count_if(F.col("null_reason") == "no_post_obs_creatinine").alias("no_post_obs_creatinine"),
    )


def class_counts(labels: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Per class: count, percent, and the balanced weight ``n / (2 * count)``."""
    per = labels.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n")
    )
    tot = per.groupBy(*by).agg(
        F.sum("n").alias("_all"),
        F.max("n").alias("_most"), F.min("n").alias("_least"),
    )
    return null_safe_join(per, tot, list(by)).select(
        *by, label, "n",
        (F.col("n") * 100.0 / F.col("_all")).alias("pct"),
        (F.col("_most") / F.col("_least")).alias("imbalance_ratio"),
        (F.col("_all") / (2.0 * F.col("n"))).alias("weight"),
    )


def numeric_summary(labels: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """mean, std, min, quartiles, max, rounded to 4 places; exact quartiles."""
    y = F.col(label).cast("double")
    base = labels.filter(y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"),
        F.min(y).alias("min"), F.max(y).alias("max"),
    )
    q = exact_quantiles(labels, list(by), label, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = null_safe_join(base, q, list(by))
    cols = [F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")]
    return out.select(*by, "n", *cols)


def infer_task_type(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per label column: binary, multiclass, regression or unknown.

    Equal values collapse first, so no task holds the set of distinct values.
    """
    cells = labels.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("task"), F.col(c).cast("double").alias("y"))
                    for c in columns
                ]
            )
        ).alias("_c")
    ).select("_c.*")
    ok = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < F.lit(float("inf")))
    distinct = cells.groupBy("task", F.when(ok, F.col("y")).alias("y")).agg(F.lit(1).alias("one"))
    per = distinct.groupBy("task").agg(
        F.count("y").alias("n_distinct"),
        F.bool_and(F.abs(F.col("y") - F.round("y")) <= 1e-8).alias("whole"),
        F.bool_and(F.round("y").isin(0.0, 1.0)).alias("zero_one"),
    )
    kind = (
        F.when(F.col("n_distinct") == 0, "unknown")
        .when(F.col("whole") & (F.col("n_distinct") <= 20) & F.col("zero_one"), "binary")
        .when(F.col("whole") & (F.col("n_distinct") <= 20), "multiclass")
        .otherwise("regression")
    )
    return per.select("task", "n_distinct", kind.alias("task_type"))


def multilabel_prevalence(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per label column: known values, positives, prevalence; one pass."""
    aggs = []
    for c in columns:
        aggs.append(
            F.struct(
                F.lit(c).alias("label_name"),
                F.count(c).alias("n"),
                F.count_if(F.col(c) == 1).alias("n_positive"),
                F.avg(F.col(c).cast("double")).alias("prevalence"),
            )
        )
    return labels.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")


def train_support(df: DataFrame) -> DataFrame:
    """Train labels: the full set against the subset used (columns ``label, in_subset``)."""
    y = F.col("label")
    aggs = []
    for name, cond in (("full_train", F.lit(True)), ("train_subset", F.col("in_subset"))):
        pos, neg = F.count_if(cond & (y == 1)), F.count_if(cond & (y == 0))
        tot = F.count_if(cond & y.isNotNull())
        aggs += [
            tot.alias(f"{name}_total"), pos.alias(f"{name}_positive"),
            neg.alias(f"{name}_negative"),
            F.when(tot > 0, pos / tot).alias(f"{name}_prevalence"),
        ]
    return df.agg(*aggs)


def support_gate(support: DataFrame, fraction: float, min_positives: int = 3) -> DataFrame:
    """Error rows of a train subset: a class is lost, or too few positives remain."""
    lost = (F.col("train_subset_positive") == 0) | (F.col("train_subset_negative") == 0)
    few = (F.lit(fraction) < 1.0) & (F.col("train_subset_positive") < min_positives)
    return support.select(
        F.when(lost, "class_lost").when(few, "too_few_positives").otherwise("ok").alias("status")
    )


def class_weights(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Softened balanced weights and the negative-to-positive ratio."""
    y = F.col("label")
    pos, neg = F.count_if(y == 1), F.count_if(y == 0)
    n = pos + neg
    return labels.groupBy(*by).agg(
        pos.alias("n_positive"), neg.alias("n_negative"),
        F.when(neg > 0, F.sqrt(n / (2.0 * neg))).alias("weight_negative"),
        F.when(pos > 0, F.sqrt(n / (2.0 * pos))).alias("weight_positive"),
        (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"),
    )


def trivial_baselines(df: DataFrame) -> DataFrame:
    """Constant predictors fit on train and scored on test (columns ``split, label``)."""
    y = F.col("label").cast("double")
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    fit = train.agg(
        F.avg(y).alias("train_label_mean"), F.stddev_pop(y).alias("train_label_std")
    ).crossJoin(exact_quantiles(train, [], "label", {"train_label_median": 0.5}, lower=True))
    scored = test.crossJoin(F.broadcast(fit))  # one row of fitted constants
    return scored.groupBy("train_label_mean", "train_label_std", "train_label_median").agg(
        F.avg(F.pow(y - F.col("train_label_mean"), 2)).alias("mean_predictor_mse"),
        F.avg(F.abs(y - F.col("train_label_median"))).alias("median_predictor_mae"),
    )


def trivial_binary_baselines(df: DataFrame) -> DataFrame:
    y = F.col("label")
    train, test = F.col("split") == "train", F.col("split") == "test"
    ratio = F.avg(F.when(train, y.cast("double")))
    test_rate = F.avg(F.when(test, y.cast("double")))
    return df.agg(
        ratio.alias("train_positive_ratio"),
        F.when(ratio >= 0.5, test_rate).otherwise(1 - test_rate).alias("majority_accuracy"),
        F.lit(0.5).alias("trivial_auroc"),
    )
