"""Sliding windows, gaps since the last value, and per-stay summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _past():
    return (
        Window.partitionBy("stay_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    )


def time_since_observed(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``{f}_delta``: hours since the feature was last seen; 0 at hour 0.

    A feature not seen yet counts from hour 0. ``rows`` is a full grid, so a stay's
    window holds a fixed number of hours.
    """
    hour = F.col("hour")
    cols = {
        f"{f}_delta": hour - F.coalesce(
            F.max(F.when(F.col(f"{f}_mask"), hour)).over(_past()), F.lit(0)
        )
        for f in features
    }
    return rows.withColumns(cols)


def last_observed(
    rows: DataFrame, features: Sequence[str], default: dict[str, float] | None = None
) -> DataFrame:
    """``{f}_last``: value last seen strictly before the hour, else the default."""
    cols = {}
    for f in features:
        seen = F.when(F.col(f"{f}_mask"), F.col(f))
        prev = F.last(seen, ignorenulls=True).over(_past())
        fallback = F.lit(None) if default is None else F.lit(default.get(f))
        cols[f"{f}_last"] = F.coalesce(prev, fallback)
    return rows.withColumns(cols)


def first_last_observed(cells: DataFrame) -> DataFrame:
    """First and last seen value per (stay, feature) of long cells."""
    seen = cells.filter("observed")
    return seen.groupBy("stay_id", "feature_name").agg(
        F.min_by("value", "hour").alias("first_value"),
        F.max_by("value", "hour").alias("last_value"),
        F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
    )


def seen_hours(mask="mask") -> Column:
    """One flag per hour: any feature observed."""
    return F.transform(F.col(mask), lambda row: F.exists(row, lambda x: x))


def actual_length(mask="mask") -> Column:
    """Last observed hour + 1; 0 when nothing was observed."""
    flags = seen_hours(mask)
    return F.size(flags) - F.coalesce(
        F.nullif(F.array_position(F.reverse(flags), F.lit(True)), F.lit(0)),
        F.size(flags) + 1,
    ).cast("int") + 1


def sliding_windows(dense: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """One row per window: starts 0, s, 2s ... that fit the series and begin before its end.

    A pure ``explode`` of the stay's own row, no shuffle. A series shorter than the
    window fails the job.
    """
    stride = size // 2 if stride is None else stride
    if size <= 0 or stride <= 0:
        raise ValueError("window size and stride must be positive")
    return _cut_windows(dense, size, F.lit(stride))


def _cut_windows(dense: DataFrame, size: int, stride: Column) -> DataFrame:
    rest = [c for c in dense.columns if c not in ("timeseries", "mask")]
    too_long = F.raise_error(F.lit(f"window size {size} exceeds the series length"))
    last = F.when(F.size("timeseries") >= size, F.size("timeseries") - size).otherwise(
        too_long.cast("int")
    )
    starts = F.sequence(F.lit(0), last, stride)
    sized = dense.withColumn("_len", actual_length())
    hit = F.explode(F.filter(starts, lambda s: s < F.col("_len"))).alias("window_start")
    begun = sized.select(*rest, "timeseries", "mask", stride.alias("_stride"), hit)
    return begun.select(
        *rest,
        "window_start",
        F.floor(F.col("window_start") / F.col("_stride")).cast("int").alias("window_idx"),
        F.slice("timeseries", F.col("window_start") + 1, F.lit(size)).alias("timeseries"),
        F.slice("mask", F.col("window_start") + 1, F.lit(size)).alias("mask"),
    )


def split_windows(dense: DataFrame, size: int, train_stride: int) -> DataFrame:
    """Train stays in overlapping windows, validation in disjoint ones, test stays whole."""
    cut = dense.filter(F.col("split").isin("train", "val"))
    stride = F.when(F.col("split") == "train", F.lit(train_stride)).otherwise(F.lit(size))
    whole = dense.filter(F.col("split") == "test").withColumns(
        {"window_start": F.lit(0), "window_idx": F.lit(0)}
    )
    return _cut_windows(cut, size, stride).unionByName(whole)


def window_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_windows"))


def window_count_stats(windows: DataFrame) -> DataFrame:
    return window_counts(windows).agg(
        F.min("n_windows").alias("min_windows"), F.max("n_windows").alias("max_windows"),
        F.avg("n_windows").alias("mean_windows"), F.sum("n_windows").alias("total_windows"),
        F.count(F.lit(1)).alias("n_stays"),
    )


def observed_tokens(dense: DataFrame, most: int | None = None) -> DataFrame:
    """``tokens``: (timestep, feature, value) of observed cells, time then feature order.

    ``n_obs`` counts them; with ``most`` the list is padded with nulls to that length.
    """
    cells = F.flatten(
        F.transform(
            F.arrays_zip("timeseries", "mask"),
            lambda row, h: F.transform(
                F.arrays_zip(row["timeseries"].alias("v"), row["mask"].alias("m")),
                lambda c, d: F.struct(
                    h.alias("timestep"), d.alias("feature"), c["v"].alias("value"),
                    c["m"].alias("seen"),
                ),
            ),
        )
    )
    kept = F.transform(
        F.filter(cells, lambda c: c["seen"]),
        lambda c: F.struct(c["timestep"], c["feature"], c["value"]),
    )
    out = dense.select("stay_id", kept.alias("tokens")).withColumn("n_obs", F.size("tokens"))
    if most is not None:
        blank = F.lit(None).cast("struct<timestep:int,feature:int,value:double>")
        gap = F.greatest(F.lit(most) - F.col("n_obs"), F.lit(0))
        out = out.withColumn("tokens", F.concat("tokens", F.array_repeat(blank, gap)))
    return out


def pool_hours(rows: DataFrame, features: Sequence[str], how: str) -> DataFrame:
    """Pool each feature over the hours that have any observation; zeros when there is none.

    ``how`` is mean, max, last, first or none (rows unchanged).
    """
    if how == "none":
        return rows
    valid = F.lit(False)
    for f in features:
        valid = valid | F.col(f"{f}_mask")
    hour = F.when(valid, F.col("hour"))
    aggs = []
    for f in features:
        v = F.when(valid, F.coalesce(F.col(f), F.lit(0.0)))
        pooled = {
            "mean": lambda v=v: F.avg(v),
            "max": lambda v=v: F.max(v),
            "last": lambda v=v: F.max_by(v, hour),
            "first": lambda v=v: F.min_by(v, hour),
        }[how]()
        aggs.append(F.coalesce(pooled, F.lit(0.0)).alias(f))
    return rows.groupBy("stay_id").agg(*aggs)


SUMMARY_NAMES = ("mean", "std", "min", "max", "first", "last", "obs_count", "obs_frac")


def tabular_summary(rows: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """``{f}__{stat}`` for eight statistics per feature, zeros when never observed.

    One grouping by stay over wide rows; population std over the observed cells.
    """
    hour = F.col("hour")
    aggs = []
    for f in features:
        seen = F.col(f"{f}_mask") & F.col(f).isNotNull()
        v, h = F.when(seen, F.col(f)), F.when(seen, hour)
        n = F.count(v)
        stats = (
            F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), F.min_by(F.col(f), h),
            F.max_by(F.col(f), h), n.cast("double"), n / F.lit(float(length)),
        )
        for name, s in zip(SUMMARY_NAMES, stats):
            aggs.append(F.coalesce(s, F.lit(0.0)).alias(f"{f}__{name}"))
    return rows.groupBy("stay_id").agg(*aggs)


def tabular_vector(rows: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """The summary as one array, feature-major, 8 numbers per feature."""
    names = [f"{f}__{s}" for f in features for s in SUMMARY_NAMES]
    wide = tabular_summary(rows, features, length)
    return wide.select("stay_id", F.array(*names).alias("features"))
