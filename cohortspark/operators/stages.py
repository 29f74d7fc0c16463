"""Inspection of processing stages: summaries, differences, label snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stage_summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, hour range, value range, observed and missing counts of long cells."""
    ok = ~F.isnan("value")
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
        F.min(F.when(ok, F.col("value"))).alias("min_value"),
        F.max(F.when(ok, F.col("value"))).alias("max_value"),
        F.count_if("observed").alias("n_observed"), F.count_if(~F.col("observed")).alias("n_missing"),
    )


def raw_summary(events: DataFrame) -> DataFrame:
    """Rows, features, span in hours, value range and NaN count of raw events."""
    span = F.unix_micros(F.max("charttime")) - F.unix_micros(F.min("charttime"))
    nan = F.isnan("valuenum")
    return events.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("feature_name").alias("n_features"),
        (span / F.lit(3_600_000_000.0)).alias("span_hours"),
        F.min(F.when(~nan, F.col("valuenum"))).alias("min_value"),
        F.max(F.when(~nan, F.col("valuenum"))).alias("max_value"),
        F.count_if(nan | F.col("valuenum").isNull()).alias("n_missing"),
    )


def stage_difference(
    before: DataFrame, after: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Full join on the keys with the change in value, absolute and in percent of ``|before|``."""
    a = before.select(*keys, F.col(value).alias("before"))
    b = after.select(*keys, F.col(value).alias("after"))
    change = F.col("after") - F.col("before")
    return a.join(b, list(keys), "full").withColumns(
        {
            "value_diff": change,
            "pct_change": F.when(F.col("before") != 0, change / F.abs("before") * 100.0),
        }
    )


def label_snapshot(labels: DataFrame) -> DataFrame:
    """mean, sum and null count of each numeric label column."""
    names = [
        f.name for f in labels.schema.fields
        if f.name != "stay_id" and isinstance(f.dataType, T.NumericType)
    ]
    n = F.count(F.lit(1))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("label_name"), F.avg(F.col(c).cast("double")).alias("mean"),
                F.sum(F.col(c).cast("double")).alias("sum"), (n - F.count(c)).alias("n_null"),
            )
            for c in names
        ]
    )
    return labels.agg(rows.alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")
