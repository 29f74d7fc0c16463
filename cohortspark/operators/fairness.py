"""Subgroup reports.

Input rows: ``stay_id, prediction, label`` joined to static data. Output rows are long:
``attr, metric, group, value``, which flatten to ``fairness/{attr}/{metric}[/{group}]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.functions import values as V
from cohortspark.operators.metrics import ranking_metrics, regression_report
from cohortspark.session import broadcast_if_small, cut_lineage

NAN = float("nan")


# --- attributes ------------------------------------------------------------------------

def available_attributes(
    static: DataFrame, wanted: Sequence[str] = C.PROTECTED_ATTRIBUTES, dataset: str | None = None
) -> list[str]:
    """Attributes whose column exists; race needs a source with race rules."""
    have = set(static.columns)
    ok = {"gender": "gender" in have, "age_group": "age" in have, "race": "race" in have}
    if dataset == "eicu":
        ok["race"] = False
    elif dataset == "combined" and ok["race"]:
        src = F.lower(F.trim(F.col("source_dataset"))) if "source_dataset" in have else None
        ok["race"] = src is not None and not static.filter(
            src.contains("miiv") | src.contains("mimic")
        ).limit(1).isEmpty()
    return [a for a in wanted if ok.get(a)]


def with_groups(
    predictions: DataFrame, static: DataFrame, attributes: Sequence[str],
    dataset: str | None = None,
) -> DataFrame:
    """Long rows (attr, group, patient_id, prediction, label); unknown groups are dropped.

    Without a patient column the stay stands for the patient.
    """
    patient = F.col("patient_id") if "patient_id" in static.columns else F.col("stay_id")
    source = "source_dataset" if "source_dataset" in static.columns else None
    exprs = {
        "gender": lambda: V.gender_group("gender"),
        "age_group": lambda: V.age_group("age"),
        "race": lambda: V.race_group("race", source, dataset),
    }
    groups = [
        F.struct(F.lit(a).alias("attr"), exprs[a]().alias("group")) for a in attributes
    ]
    people = static.select("stay_id", patient.alias("patient_id"), F.array(*groups).alias("_g"))
    joined = predictions.join(people, "stay_id", "left")
    rows = joined.withColumn("_g", F.explode("_g")).select(
        "stay_id", F.coalesce("patient_id", "stay_id").alias("patient_id"), "prediction", "label",
        "_g.attr", "_g.group",
    )
    return rows.filter(F.col("group").isNotNull())


def group_sizes(rows: DataFrame, min_patients: int = C.MIN_SUBGROUP_PATIENTS) -> DataFrame:
    """Patients and stays per (attr, group); valid groups; attributes with two of them."""
    per = rows.groupBy("attr", "group").agg(
        F.count_distinct("patient_id").alias("n_patients"), F.count(F.lit(1)).alias("n_stays")
    )
    per = cut_lineage(per)  # read by the filters and by every report
    valid = per.withColumn("valid", F.col("n_patients") >= min_patients)
    kept = valid.groupBy("attr").agg(F.count_if("valid").alias("n_valid_groups"))
    return valid.join(kept, "attr").withColumn("reported", F.col("n_valid_groups") >= 2)


def valid_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the size-valid groups of reported attributes.

    The groups are few, so after a check of their number they are sent to the rows
    and a group with a third of all rows is not shuffled.
    """
    ok = sizes.filter("valid and reported").select("attr", "group")
    return rows.join(broadcast_if_small(ok, 10_000), ["attr", "group"], "left_semi")


# --- primitives ---------------------------------------------------------------------------

def subgroup_rates(
    rows: DataFrame, by: Sequence[str] = ("attr", "group"), threshold: float = 0.5,
    min_size: int = 0,
) -> DataFrame:
    """n, positive rate, TPR, FPR per group; a rate without its class is null."""
    hit, y = F.col("prediction") >= threshold, F.col("label")

    def share(cond):
        return F.avg(F.when(cond, hit.cast("double")))

    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(hit.cast("double")).alias("positive_rate"),
        share(y == 1).alias("tpr"), share(y == 0).alias("fpr"),
    ).filter(F.col("n_samples") >= min_size)


def parity(rates: DataFrame, by: Sequence[str] = ("attr",)) -> DataFrame:
    """Demographic parity difference, equalized odds difference, disparate impact ratio.

    Fewer than two groups: 0, 0 and 1. A group without one of the classes makes the
    odds undefined. A largest rate of 0 means a ratio of 1.
    """
    k = F.count(F.lit(1))
    rate = F.col("positive_rate")
    complete = F.bool_and(F.col("tpr").isNotNull() & F.col("fpr").isNotNull())
    odds = F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr"))
    return rates.groupBy(*by).agg(
        F.when(k < 2, 0.0).otherwise(F.max(rate) - F.min(rate)).alias("demographic_parity_diff"),
        F.when(k < 2, 0.0).when(complete, odds).otherwise(NAN).alias("equalized_odds_diff"),
        F.when((k < 2) | (F.max(rate) == 0), 1.0).otherwise(F.min(rate) / F.max(rate))
        .alias("disparate_impact_ratio"),
    ).withColumn("four_fifths_violation", F.col("disparate_impact_ratio") < 0.8)


# --- reports ----------------------------------------------------------------------------------

def binary_fairness(rows: DataFrame, min_patients: int = C.MIN_SUBGROUP_PATIENTS) -> DataFrame:
    """One row per reported attribute: worst groups, gaps, parity, group counts."""
    sizes = group_sizes(rows, min_patients)
    ok = valid_rows(rows, sizes)
    ranked = ranking_metrics(ok, ["attr", "group"])
    two = ~F.isnan("auroc")
    comparable = F.count_if(two) >= 2

    def spread(name, gap):
        v = F.when(two, F.col(name))
        return F.when(comparable, F.max(v) - F.min(v) if gap else F.min(v)).otherwise(NAN)

    per = ranked.groupBy("attr").agg(
        spread("auroc", False).alias("worst_group_auroc"),
        spread("auprc", False).alias("worst_group_auprc"),
        spread("auroc", True).alias("auroc_gap"), spread("auprc", True).alias("auprc_gap"),
        F.count(F.lit(1)).alias("n_valid_groups"),
        F.count_if(two).alias("n_metric_valid_groups"),
        F.count_if(~two).alias("n_single_class_groups"),
    )
    return per.join(parity(subgroup_rates(ok)).drop("four_fifths_violation"), "attr")


def binary_group_scores(rows: DataFrame, min_patients: int = C.MIN_SUBGROUP_PATIENTS) -> DataFrame:
    """Per reported group: AUROC, AUPRC, patients, stays."""
    sizes = group_sizes(rows, min_patients)
    ranked = ranking_metrics(valid_rows(rows, sizes), ["attr", "group"])
    return ranked.join(sizes.select("attr", "group", "n_patients", "n_stays"), ["attr", "group"]) \
        .select("attr", "group", "n_patients", "n_stays", "auroc", "auprc")


def regression_fairness(rows: DataFrame, min_patients: int = C.MIN_SUBGROUP_PATIENTS) -> DataFrame:
    """One row per reported attribute: worst (largest) errors and their gaps."""
    ok = valid_rows(rows, group_sizes(rows, min_patients))
    per = regression_report(ok, ["attr", "group"], floor=1e-8)
    return per.groupBy("attr").agg(
        F.max("mse").alias("worst_group_mse"), F.max("mae").alias("worst_group_mae"),
        (F.max("mse") - F.min("mse")).alias("mse_gap"),
        (F.max("mae") - F.min("mae")).alias("mae_gap"),
        F.count(F.lit(1)).alias("n_valid_groups"),
    )


def regression_group_scores(rows: DataFrame, min_patients: int = C.MIN_SUBGROUP_PATIENTS):
    ok = valid_rows(rows, group_sizes(rows, min_patients))
    return regression_report(ok, ["attr", "group"], floor=1e-8).drop("rmse")


# --- flattening -----------------------------------------------------------------------------------

def long_report(summary: DataFrame, per_group: DataFrame | None = None) -> DataFrame:
    """(attr, metric, group, value) from the wide reports."""

    def melt(df, ids, group):
        names = [c for c in df.columns if c not in ids]
        cells = F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
            )
        )
        return df.select("attr", group.alias("group"), cells.alias("_c")).select(
            "attr", "_c.metric", "group", "_c.value"
        )

    out = melt(summary, {"attr"}, F.lit(None).cast("string"))
    if per_group is not None:
        named = per_group
        for c in per_group.columns:
            if c not in ("attr", "group"):
                named = named.withColumnRenamed(c, f"per_group_{c}")
        out = out.unionByName(melt(named, {"attr", "group"}, F.col("group")))
    return out


def flat_keys(report: DataFrame) -> DataFrame:
    """(key, value) with keys ``fairness/{attr}/{metric}[/{group}]``."""
    return report.select(
        F.concat_ws("/", F.lit("fairness"), "attr", "metric", "group").alias("key"), "value"
    )


def flat_map(report: DataFrame) -> DataFrame:
    """The flat report as one map; its size is the number of groups and metrics."""
    keys = flat_keys(report)
    return keys.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fairness"))
