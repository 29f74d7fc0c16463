"""Scores of predictions: ranking, threshold, calibration, regression, imputation.

Frames carry ``prediction`` and ``label``; every function takes group columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ordering import null_safe_join, running_totals

BINARY_METRICS = (
    "auroc", "auprc", "accuracy", "f1", "precision", "recall", "specificity", "brier_score", "ece",
)
REGRESSION_METRICS = ("mse", "mae", "rmse", "r2")
# The metrics a task type allows, and those it reports if none are named.
ALLOWED_METRICS = {
    "binary": BINARY_METRICS,
    "multiclass": ("auroc", "auprc", "accuracy", "f1", "precision", "recall"),
    "multilabel": ("auroc", "auprc", "accuracy", "f1"),
    "regression": REGRESSION_METRICS,
}
DEFAULT_METRICS = {
    "binary": BINARY_METRICS,
    "multiclass": ("auroc", "accuracy"),
    "multilabel": ("auroc",),
    "regression": ("mse", "mae", "r2"),
}


def check_metric_names(task_type: str, names: Sequence[str] | None = None) -> tuple[str, ...]:
    """Defaults of the task type, or the given names after a check."""
    if task_type not in ALLOWED_METRICS:
        raise ValueError(f"unknown task type {task_type!r}; use one of {sorted(ALLOWED_METRICS)}")
    allowed = ALLOWED_METRICS[task_type]
    bad = sorted(set(names or ()) - set(allowed))
    if bad:
        raise ValueError(f"metrics {bad} do not apply to {task_type}; allowed: {allowed}")
    return tuple(names or DEFAULT_METRICS[task_type])


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when undefined."""
    return F.when(b > 0, a / b).otherwise(0.0)


# --- ranking -----------------------------------------------------------------------

def ranking_metrics(
    df: DataFrame, by: Sequence[str] = (), score: str = "prediction", label: str = "label",
    weight: str | None = None,
) -> DataFrame:
    """Exact, tie-aware AUROC and average precision per group; NaN with one class.

    Equal scores collapse to counts first. Running counts by falling score come from
    bucket offsets, so a group of any size is spread over many tasks.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    ties = (
        df.withColumn("_s", -F.col(score).cast("double"))
        .groupBy(*by, "_s")
        .agg(
            F.sum(F.when(y == 1, w).otherwise(0)).cast("double").alias("pos"),
            F.sum(F.when(y == 0, w).otherwise(0)).cast("double").alias("neg"),
        )
    )
    cum = running_totals(ties, by, "_s", ["pos", "neg"])
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    # pairs ranked the wrong way round, ties as halves
    wrong = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    gain = F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0)
    per = cum.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(wrong).alias("_wrong"), F.sum(gain).alias("_gain"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    nan = F.lit(float("nan"))
    return per.select(
        *by,
        (F.col("n_pos") + F.col("n_neg")).cast("bigint").alias("n"),
        F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
        F.when(both, 1.0 - F.col("_wrong") / (F.col("n_pos") * F.col("n_neg"))).otherwise(nan)
        .alias("auroc"),
        F.when(both, F.col("_gain") / F.col("n_pos")).otherwise(nan).alias("auprc"),
    )


# --- threshold and calibration -------------------------------------------------------

def confusion(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn and the rates built on them."""
    hit, y = F.col("prediction") >= threshold, F.col("label")
    c = df.groupBy(*by).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(~hit & (y == 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "specificity": _ratio(tn, tn + fp),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(F.pow(F.col("prediction") - F.col("label"), 2)).alias("brier_score")
    )


def calibration_bins(df: DataFrame, by: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """Per uniform bin: n, mean prediction, share of positives; the last bin is closed."""
    i = F.least(F.floor(F.col("prediction") * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", i).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("confidence"),
        F.avg(F.col("label").cast("double")).alias("accuracy"),
    )


def expected_calibration_error(df: DataFrame, by: Sequence[str] = (), bins: int = 15) -> DataFrame:
    gap = F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")
    return calibration_bins(df, by, bins).groupBy(*by).agg(
        (F.sum(gap) / F.sum("n")).alias("ece")
    )


def binary_report(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """All binary metrics per group in one row."""
    by = list(by)
    out = ranking_metrics(df, by).drop("n_pos", "n_neg")
    for part in (
        confusion(df, by, threshold).drop("tp", "fp", "tn", "fn"),
        brier(df, by),
        expected_calibration_error(df, by),
    ):
        out = null_safe_join(out, part, by)
    return out


def support(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    y, n = F.col("label"), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n_samples"), F.count_if(y == 1).alias("n_positive"),
        (n - F.count_if(y == 1)).alias("n_negative"),
        (F.count_if(y == 1) / n).alias("positive_ratio"),
    )


# --- several classes -------------------------------------------------------------------

def one_vs_rest(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """(class, prediction, label) rows of a score array; label 1 for the row's class."""
    rest = [c for c in df.columns if c not in (scores, label)]
    return df.select(*rest, F.col(label).alias("_y"), F.posexplode(scores).alias("class", "prediction")) \
        .withColumn("label", (F.col("_y") == F.col("class")).cast("int")).drop("_y")


def multilabel_rows(df: DataFrame, scores: str = "scores", labels: str = "labels") -> DataFrame:
    """(class, prediction, label) rows of aligned score and label arrays."""
    return df.select(
        F.posexplode(F.arrays_zip(F.col(scores).alias("s"), F.col(labels).alias("y"))).alias("class", "_c")
    ).select("class", F.col("_c.s").alias("prediction"), F.col("_c.y").alias("label"))


def multiclass_report(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Macro AUROC and AUPRC; accuracy, f1, precision, recall micro-averaged.

    With one predicted class per row the four micro averages are the same number.
    """
    ranked = ranking_metrics(one_vs_rest(df, scores, label), ["class"])
    macro = ranked.agg(
        F.avg(F.when(~F.isnan("auroc"), F.col("auroc"))).alias("auroc"),
        F.avg(F.when(~F.isnan("auprc"), F.col("auprc"))).alias("auprc"),
    )
    top = F.array_position(F.col(scores), F.array_max(scores)) - 1
    hit = F.avg((top == F.col(label)).cast("double"))
    micro = df.agg(*[hit.alias(m) for m in ("accuracy", "f1", "precision", "recall")])
    return macro.crossJoin(F.broadcast(micro))  # two one-row frames


def multilabel_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Macro AUROC and AUPRC, micro accuracy and f1 over all (row, label) cells."""
    ranked = ranking_metrics(rows, ["class"])
    macro = ranked.agg(
        F.avg(F.when(~F.isnan("auroc"), F.col("auroc"))).alias("auroc"),
        F.avg(F.when(~F.isnan("auprc"), F.col("auprc"))).alias("auprc"),
    )
    micro = confusion(rows, (), threshold).select("accuracy", "f1")
    return macro.crossJoin(F.broadcast(micro))  # two one-row frames


# --- regression ---------------------------------------------------------------------------

def regression_report(df: DataFrame, by: Sequence[str] = (), floor: float = 0.0) -> DataFrame:
    """MSE, MAE, RMSE and R2; ``floor`` bounds the total sum of squares from below."""
    y, p = F.col("label").cast("double"), F.col("prediction").cast("double")
    err = p - y
    n = F.count(F.lit(1))
    mse = F.avg(err * err)
    total = F.var_pop(y) * n
    safe = F.greatest(total, F.lit(floor)) if floor else total
    r2 = F.when(safe > 0, 1.0 - F.sum(err * err) / safe).otherwise(float("nan"))
    return df.groupBy(*by).agg(
        n.alias("n"), mse.alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sqrt(mse).alias("rmse"), r2.alias("r2"),
    )


# --- imputation -----------------------------------------------------------------------------

def observed_stds(cells: DataFrame) -> DataFrame:
    """Sample std of the observed values per feature, 1 when there is at most one."""
    v = F.when(F.col("observed"), F.col("value"))
    n = F.count(v)
    return cells.groupBy("feature_name").agg(
        n.alias("n_obs"), F.when(n <= 1, 1.0).otherwise(F.stddev_samp(v)).alias("std")
    ).filter("n_obs > 0")


def imputation_errors(cells: DataFrame, stds: DataFrame) -> DataFrame:
    """Per feature NRMSE and MAE over the ``held_out`` cells (``value`` against ``filled``)."""
    err = F.col("filled") - F.col("value")
    per = cells.filter("held_out").groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("_mse"),
        F.sum(F.abs(err)).alias("abs_error"),
    )
    joined = per.join(stds.select("feature_name", "std"), "feature_name", "left")
    denom = F.greatest(F.coalesce(F.col("std"), F.lit(1.0)), F.lit(1e-8))
    return joined.select(
        "feature_name", "n", (F.sqrt("_mse") / denom).alias("nrmse"), "abs_error",
        (F.col("abs_error") / F.col("n")).alias("mae"),
    )


def imputation_summary(per_feature: DataFrame) -> DataFrame:
    return per_feature.agg(
        F.avg("nrmse").alias("nrmse_overall"),
        (F.sum("abs_error") / F.sum("n")).alias("mae_overall"),
        F.sum("n").alias("n_cells"),
    )


# --- expected precision of an AUROC --------------------------------------------------------------

Z_95 = 1.959963984540054


def auroc_precision(counts: DataFrame, auroc: float = 0.85, z: float = Z_95) -> DataFrame:
    """Standard error of an AUROC from class counts, with clipped interval bounds."""
    p, n = F.col("n_positive"), F.col("n_negative")
    q1, q2 = auroc / (2.0 - auroc), 2.0 * auroc * auroc / (1.0 + auroc)
    a2 = auroc * auroc
    spread = F.lit(auroc * (1.0 - auroc)) + (p - 1) * (q1 - a2) + (n - 1) * (q2 - a2)
    se = F.when((p == 0) | (n == 0), float("inf")).otherwise(
        F.sqrt(F.greatest(spread, F.lit(0.0)) / (p * n))
    )
    return counts.withColumn("auroc_se", se).withColumns(
        {
            "auroc_low": F.greatest(F.lit(0.5), auroc - z * F.col("auroc_se")),
            "auroc_high": F.least(F.lit(1.0), auroc + z * F.col("auroc_se")),
        }
    )


# --- scoring -----------------------------------------------------------------------------------

def score(df: DataFrame, fn: Callable, schema: str = "stay_id long, prediction double") -> DataFrame:
    """Apply a caller's model to Arrow batches; ``fn`` maps one pandas batch to another.

    A two-column score (``p0``, ``p1``) is reduced to its positive column.
    """

    def run(batches):
        for pdf in batches:
            out = fn(pdf)
            if "p1" in out.columns and "prediction" not in out.columns:
                out = out.rename(columns={"p1": "prediction"}).drop(columns=["p0"], errors="ignore")
            yield out

    return df.mapInPandas(run, schema)
