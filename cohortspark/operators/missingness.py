"""How much of a grid is observed: overall, per feature, hour, stay and group.

The functions read wide grid rows (one row per stay and hour with ``{f}_mask``),
so counts per feature come from one scan with no explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.values import report_bins
from cohortspark.operators.grid import observed_cells
from cohortspark.operators.ordering import exact_quantiles, null_safe_join


def _row_observed(features: Sequence[str]) -> Column:
    out = F.lit(0)
    for f in features:
        out = out + F.col(f"{f}_mask").cast("int")
    return out


def _pct_missing(observed: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * (1.0 - observed / total))


def overall(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    seen, cells = F.sum(_row_observed(features)), F.count(F.lit(1)) * len(features)
    return rows.agg(
        cells.alias("total_cells"), seen.alias("total_observed"),
        (cells - seen).alias("total_missing"), _pct_missing(seen, cells).alias("missing_pct"),
    )


def per_feature(rows: DataFrame, features: Sequence[str], present: Column | None = None) -> DataFrame:
    """Per feature; ``present`` restricts to hours inside the stay."""
    if present is not None:
        rows = rows.filter(present)
    n = F.count(F.lit(1))
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.count_if(F.col(f"{f}_mask")).alias("observed_count"),
                n.alias("total_count"),
            )
            for f in features
        ]
    )
    out = rows.agg(cells.alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")
    return out.withColumn("missing_pct", _pct_missing(F.col("observed_count"), F.col("total_count")))


def extremes(per: DataFrame, n: int) -> DataFrame:
    """The n features with most and with least missing values."""
    most = per.orderBy(F.col("missing_pct").desc(), "feature").limit(n)
    least = per.orderBy("missing_pct", "feature").limit(n)
    return most.withColumn("end", F.lit("top")).unionByName(least.withColumn("end", F.lit("bottom")))


def per_stay(dense: DataFrame) -> DataFrame:
    """From dense rows: no shuffle, each stay holds its own mask."""
    seen = observed_cells().cast("bigint")
    total = F.aggregate(F.transform("mask", F.size), F.lit(0), lambda a, x: a + x).cast("bigint")
    return dense.select(
        "stay_id", total.alias("n_total"), seen.alias("n_observed"),
        F.when(total > 0, 100.0 * (1.0 - seen / total)).otherwise(100.0).alias("missingness_pct"),
    )


def per_stay_rows(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same from wide rows."""
    seen, cells = F.sum(_row_observed(features)), F.count(F.lit(1)) * len(features)
    return rows.groupBy("stay_id").agg(
        cells.alias("total_cells"), seen.alias("observed_cells"),
        (cells - seen).alias("missing_cells"), _pct_missing(seen, cells).alias("missing_pct"),
    )


def by_group(
    stays: DataFrame, static: DataFrame, group: str, pct: str = "missing_pct"
) -> DataFrame:
    """n, mean, std, exact median, min, max of the stays' missing share per group."""
    joined = stays.join(static.select("stay_id", group), "stay_id")
    v = F.col(pct)
    base = joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_patients"), F.avg(v).alias("mean_missing_pct"),
        F.stddev_samp(v).alias("std_missing_pct"), F.min(v).alias("min_missing_pct"),
        F.max(v).alias("max_missing_pct"),
    )
    med = exact_quantiles(joined, [group], pct, {"median_missing_pct": 0.5})
    return null_safe_join(base, med, [group])


def per_hour(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    seen, cells = F.sum(_row_observed(features)), F.count(F.lit(1)) * len(features)
    return rows.groupBy("hour").agg(
        seen.alias("observed_count"), cells.alias("total_count"),
        _pct_missing(seen, cells).alias("missing_pct"),
    )


# --- present hours only -------------------------------------------------------------------

def stay_hours(length: int) -> Column:
    """Whole hours of the stay inside the grid."""
    return F.least(F.ceil(F.col("los_days") * 24.0), F.lit(length)).cast("int")


def with_presence(rows: DataFrame, static: DataFrame, length: int) -> DataFrame:
    """Adds ``present``: the hour lies inside the stay."""
    hours = static.select("stay_id", stay_hours(length).alias("los_hours"))
    return rows.join(hours, "stay_id").withColumn("present", F.col("hour") < F.col("los_hours"))


def true_and_structural(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cells missing while the patient was there, against cells after the stay."""
    d = len(features)
    here = F.col("present")
    seen = F.sum(F.when(here, _row_observed(features)).otherwise(0))
    there, all_cells = F.count_if(here) * d, F.count(F.lit(1)) * d
    return rows.agg(
        all_cells.alias("total_cells"), seen.alias("total_observed"),
        (there - seen).alias("total_true_missing"), (all_cells - there).alias("total_structural_missing"),
        F.when(there > 0, 100.0 * (there - seen) / there).otherwise(0.0).alias("true_missing_pct"),
        (100.0 * (all_cells - there) / all_cells).alias("structural_pct"),
    )


def per_stay_true(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    d = len(features)
    here = F.col("present")
    seen, there = F.sum(F.when(here, _row_observed(features)).otherwise(0)), F.count_if(here) * d
    return rows.groupBy("stay_id").agg(
        F.max("los_hours").alias("los_hours"), there.alias("true_window_cells"),
        seen.alias("true_window_observed"),
        F.when(there > 0, 100.0 * (there - seen) / there).otherwise(100.0).alias("true_missing_pct"),
        (F.count(F.lit(1)) * d - there).alias("structural_cells"),
    )


def per_hour_true(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    here = F.col("present")
    seen = F.sum(F.when(here, _row_observed(features)).otherwise(0))
    there = F.count_if(here)
    cells = there * len(features)
    return rows.groupBy("hour").agg(
        seen.alias("observed_count"), there.alias("patients_present"), cells.alias("total_count"),
        F.when(cells > 0, 100.0 * (1.0 - seen / cells)).otherwise(float("nan")).alias("missing_pct"),
    )


# --- distribution ------------------------------------------------------------------------------

BUCKET_EDGES = (0, 50, 60, 70, 80, 90, 95, 100)


def distribution(stays: DataFrame, pct: str = "missing_pct") -> DataFrame:
    v = F.col(pct)
    base = stays.agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    q = exact_quantiles(stays, [], pct, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.crossJoin(q)  # two one-row frames


def histogram(stays: DataFrame, pct: str = "missing_pct") -> DataFrame:
    """Counts in the left-closed buckets; a full 100 % falls in none."""
    edges = BUCKET_EDGES
    labels = [f"{a}-{b}" for a, b in zip(edges, edges[1:])]
    inside = stays.filter((F.col(pct) >= edges[0]) & (F.col(pct) < edges[-1]))
    bucket = report_bins(pct, edges[1:-1], labels)
    return inside.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_patients"))


def dense_against_true(hourly: DataFrame, hourly_true: DataFrame) -> DataFrame:
    a = hourly.select("hour", F.col("missing_pct").alias("dense_pct"))
    b = hourly_true.select("hour", F.col("missing_pct").alias("true_pct"))
    return a.join(b, "hour").withColumn("difference", F.col("dense_pct") - F.col("true_pct"))
