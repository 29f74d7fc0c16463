"""Train-only feature statistics and their use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.hashing import set_fingerprint
from cohortspark.operators.ordering import null_safe_join

STD_FLOOR = 1e-6


def _usable(value: Column, observed: Column, policy: str) -> Column:
    ok = observed & value.isNotNull() & ~F.isnan(value)
    if policy == "repair":
        ok = ok & (F.abs(value) < F.lit(float("inf")))
    return F.when(ok, value)


def feature_states(
    rows: DataFrame, features: Sequence[str], policy: str = "repair", by: Sequence[str] = ()
) -> DataFrame:
    """(by, feature_idx, feature, n_obs, mean, m2): what the statistics of observed cells are made of.

    States of disjoint rows add up (``merged_states``), so new stays need no second look at old ones. All
    features come from one scan.
    """
    states = []
    for i, f in enumerate(features):
        v = _usable(F.col(f).cast("double"), F.col(f"{f}_mask"), policy)
        n = F.count(v)
        states.append(
            F.struct(
                F.lit(i).alias("feature_idx"), F.lit(f).alias("feature"), n.alias("n_obs"),
                F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("m2"),
            )
        )
    return rows.groupBy(*by).agg(F.array(*states).alias("_s")).select(*by, F.explode("_s").alias("_r")).select(*by, "_r.*")


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per feature (and ``by``) from the states of parts.

    The spread of a whole is that of its parts around their own means, plus that of the means around the common one.
    """
    keys = [*by, "feature_idx", "feature"]
    whole = states.groupBy(*keys).agg(F.sum("n_obs").alias("_n"), F.sum(F.col("n_obs") * F.col("mean")).alias("_t"))
    whole = whole.select(*keys, F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(0.0).alias("_mean"))
    gap = F.col("mean") - F.col("_mean")
    return null_safe_join(states, whole, keys).groupBy(*keys).agg(
        F.sum("n_obs").alias("n_obs"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n_obs") * gap * gap).alias("m2")
    )


def stats_of(states: DataFrame, policy: str = "repair") -> DataFrame:
    """(feature_idx, feature, mean, std, n_obs) of one state per feature."""
    n = F.col("n_obs")
    std = F.when(n > 1, F.sqrt(F.col("m2") / (n - 1)))
    if policy == "repair":
        fixed = F.when(F.coalesce(std, F.lit(0.0)) <= STD_FLOOR, 1.0).otherwise(std)
    else:
        fixed = F.when(n <= 1, 1.0).otherwise(F.greatest(std, F.lit(STD_FLOOR)))
    return states.select("feature_idx", "feature", "mean", fixed.alias("std"), "n_obs")


def feature_stats(
    rows: DataFrame, features: Sequence[str], policy: str = "repair", only_train: bool = True
) -> DataFrame:
    """(feature_idx, feature, mean, std, n_obs) over the observed cells of wide rows.

    ``policy='repair'`` drops infinite cells and turns a std of at most 1e-6 into 1;
    ``'clamp'`` keeps them and lifts the std to 1e-6 (1 when n <= 1). All features
    come from one scan; a ``split`` column restricts the fit to the train stays. Hours without an observed
    cell need not be there.
    """
    if only_train:
        if "split" not in rows.columns:
            raise ValueError("train-only statistics need a split column")
        rows = rows.filter(F.col("split") == "train")
    return stats_of(feature_states(rows, features, policy), policy)


def updated_stats(
    spark, path: str, rows: DataFrame, features: Sequence[str], part: str, policy: str = "repair"
) -> DataFrame:
    """Statistics of all parts written under ``path``, after the state of ``part`` was written from ``rows``.

    A part that is there already is not read again. Only states are merged: a row per feature and part.
    """
    from cohortspark.sources.tables import path_exists

    where = f"{path}/part={part}"
    if not path_exists(spark, where):
        feature_states(rows, features, policy).coalesce(1).write.mode("overwrite").parquet(where)
    states = spark.read.parquet(path).filter(F.col("feature").isin(*features))
    return stats_of(merged_states(states), policy)


def stats_row(stats: DataFrame) -> DataFrame:
    """The statistics as one row of two arrays in feature order; size = number of features."""
    ordered = F.sort_array(F.collect_list(F.struct("feature_idx", "mean", "std")))
    return stats.agg(ordered.alias("_a")).select(
        F.transform("_a", lambda s: s["mean"]).alias("_means"),
        F.transform("_a", lambda s: s["std"]).alias("_stds"),
    )


def normalize_dense(dense: DataFrame, stats: DataFrame, zscore: bool = True) -> DataFrame:
    """z-scores with missing cells 0, or raw values with missing cells at the feature mean."""
    df = dense.crossJoin(F.broadcast(stats_row(stats)))  # one row per feature set

    def cell(c, d):
        missing = c["x"].isNull() | F.isnan(c["x"]) | ~c["m"]
        mean, std = F.col("_means")[d], F.col("_stds")[d]
        if zscore:
            return F.when(missing, F.lit(0.0)).otherwise((c["x"] - mean) / std)
        return F.when(missing, mean).otherwise(c["x"])

    both = F.arrays_zip(F.col("timeseries").alias("x"), F.col("mask").alias("m"))
    scaled = F.transform(
        both, lambda r: F.transform(F.arrays_zip(r["x"].alias("x"), r["m"].alias("m")), cell)
    )
    return df.withColumn("timeseries", scaled).drop("_means", "_stds")


def normalize_rows(
    rows: DataFrame, stats: DataFrame, features: Sequence[str], zscore: bool = True
) -> DataFrame:
    """The same on wide rows: plain column arithmetic, whole-stage code."""
    df = rows.crossJoin(F.broadcast(stats_row(stats)))
    cols = {}
    for i, f in enumerate(features):
        v = F.when(F.coalesce(F.col(f"{f}_mask"), F.lit(False)) & ~F.isnan(f), F.col(f))
        mean, std = F.col("_means")[i], F.col("_stds")[i]
        cols[f] = F.coalesce((v - mean) / std, F.lit(0.0)) if zscore else F.coalesce(v, mean)
    return df.withColumns(cols).drop("_means", "_stds")


def inspect_stay(dense: DataFrame, stats: DataFrame, stay_id: int) -> DataFrame:
    """One stay before and after normalization."""
    one = dense.filter(F.col("stay_id") == stay_id)
    done = normalize_dense(one, stats).select("stay_id", F.col("timeseries").alias("normalized"))
    return one.withColumnRenamed("timeseries", "grid").join(done, "stay_id")


def split_hash(assigned: DataFrame) -> DataFrame:
    """Order-free fingerprint of the train stays, the key of stored statistics."""
    return assigned.filter(F.col("split") == "train").agg(
        set_fingerprint("stay_id").alias("split_hash")
    )


def stored_or_computed(spark, path: str, key: str, compute) -> DataFrame:
    """Statistics stored under ``path/key=<key>``, computed and written when absent."""
    from cohortspark.sources.tables import path_exists

    where = f"{path}/key={key}"
    if not path_exists(spark, where):
        compute().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
