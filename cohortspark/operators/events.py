"""Raw events to hourly feature columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.config import ConceptRule

#: named unit transforms (V4); register more with ``TRANSFORMS[name] = fn``
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "fahrenheit_to_celsius": lambda v: (v - 32.0) * 5.0 / 9.0,
    "fraction_to_percent": lambda v: v * 100.0,
    "log1p": lambda v: F.log1p(v),
}


def apply_concept_rules(
    raw: DataFrame, rules: Sequence[ConceptRule], item="item_id", text="label", value="value"
) -> DataFrame:
    """Give each raw row the features whose rule it meets, and its cleaned value.

    Item-id, exact-string and regex rules test the row; a ``column`` rule reads the
    named column instead of ``value``. One pass, no join: the rules are settings.
    Values are transformed, then nulled when outside the rule's range. A row that
    meets several rules yields several rows; a row that meets none is dropped.
    """
    found = []
    for r in rules:
        v = F.col(r.match[0]) if r.kind == "column" else F.col(value)
        if r.kind == "column":
            hit = v.isNotNull()
        elif r.kind == "item":
            hit = F.col(item).isin(*r.match)
        elif r.kind == "string":
            hit = F.col(text).isin(*r.match)
        else:
            hit = F.lit(False)
            for pattern in r.match:
                hit = hit | F.col(text).rlike(pattern)
        found.append(
            F.when(
                F.coalesce(hit, F.lit(False)),
                F.struct(F.lit(r.feature).alias("feature"), clean_value(v, r).alias("value")),
            )
        )
    keep = [c for c in raw.columns if c not in ("feature", "value")]
    pairs = F.explode(F.filter(F.array(*found), lambda s: s.isNotNull()))
    return raw.select(*keep, pairs.alias("_p")).select(*keep, "_p.feature", "_p.value")


def clean_value(v: Column, rule: ConceptRule) -> Column:
    """Unit transform, then null outside ``[lo, hi]``."""
    v = v.cast("double")
    if rule.transform:
        v = TRANSFORMS[rule.transform](v)
    ok = F.lit(True)
    if rule.lo is not None:
        ok = ok & (v >= rule.lo)
    if rule.hi is not None:
        ok = ok & (v <= rule.hi)
    return F.when(ok, v)


def _bin_expr(rule: ConceptRule, value: str, order: Column) -> Column:
    mine = (F.col("feature") == rule.feature) & F.col(value).isNotNull()
    v = F.when(mine, F.col(value))
    if rule.agg == "mean":
        return F.avg(v)
    if rule.agg == "sum":
        return F.sum(v)
    if rule.agg == "max":
        return F.max(v)
    if rule.agg == "min":
        return F.min(v)
    if rule.agg == "any":
        return F.max(F.when(mine, (F.col(value) != 0).cast("double")))
    pick = F.max_by if rule.agg == "last" else F.min_by
    return pick(F.col(value), F.when(mine, order))


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """A sort key for first / last picks that keeps the aggregation a hash aggregation.

    A (timestamp, whole number) pair becomes one decimal: a struct key would make Spark
    sort all rows by group before and after the shuffle. Other keys stay a struct.
    """
    kinds = [dict(df.dtypes)[c] for c in order]
    if len(order) == 1:
        return F.col(order[0])
    if kinds[0] != "timestamp" or len(order) != 2 or kinds[1] not in ("int", "bigint"):
        return F.struct(*[F.col(c) for c in order])
    # room for any 64-bit second part; a missing time sorts before every real one
    room = F.lit("20000000000000000000").cast("decimal(20,0)")
    micros = F.coalesce(F.unix_micros(order[0]), F.lit(-(10**17))).cast("decimal(18,0)")
    tie = F.coalesce(F.col(order[1]).cast("bigint"), F.lit(-(2**63) + 1)).cast("decimal(19,0)")
    return ((micros * room).cast("decimal(38,0)") + tie).cast("decimal(38,0)")


def hourly_bins(
    events: DataFrame, rules: Sequence[ConceptRule], order: Sequence[str] = ("ts", "event_id"),
    value: str = "value", max_hour: int | None = None,
) -> DataFrame:
    """One row per (stay_id, hour) with ``{f}`` and ``{f}_mask`` for every rule.

    A single grouped aggregation with conditional aggregates per feature: each task
    first reduces its own rows in a hash table, so a stay that owns a third of the
    events sends at most one row per hour and task to the shuffle.
    """
    if max_hour is not None:
        events = events.filter((F.col("hour") >= 0) & (F.col("hour") < max_hour))
    events = events.filter(F.col("feature").isin(*[r.feature for r in rules]))
    key = order_key(events, order)
    binned = events.groupBy("stay_id", "hour").agg(
        *[_bin_expr(r, value, key).alias(r.feature) for r in rules]
    )
    return with_masks(binned, [r.feature for r in rules])


def with_masks(binned: DataFrame, features: Sequence[str]) -> DataFrame:
    """``{f}_mask`` = the value is present."""
    rest = [c for c in binned.columns if c not in features]
    pairs = []
    for f in features:
        pairs += [F.col(f), F.col(f).isNotNull().alias(f"{f}_mask")]
    return binned.select(*rest, *pairs)


def merge_batches(batches: Sequence[DataFrame], features: Sequence[str]) -> DataFrame:
    """Full outer merge of pre-binned feature batches on (stay_id, hour).

    Written as a union plus one grouping: the same rows as a chain of full joins,
    with one shuffle instead of one per batch.
    """
    merged = batches[0]
    for b in batches[1:]:
        merged = merged.unionByName(b, allowMissingColumns=True)
    return merged.groupBy("stay_id", "hour").agg(*[F.max(f).alias(f) for f in features])


def fill_stay_hours(
    binned: DataFrame, stays: DataFrame, features: Sequence[str], horizon: int, unique: bool = False
) -> DataFrame:
    """Every hour of each stay up to ``min(ceil(los), horizon)``, gaps as null / False."""
    from cohortspark.operators.grid import stay_hours

    inside = binned.filter((F.col("hour") >= 0) & (F.col("hour") < horizon))
    hours = F.least(F.ceil(F.col("los_days") * 24.0), F.lit(horizon))
    return stay_hours(inside, stays, features, hours, unique)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by the order columns.

    The first row of a window: each task keeps one row per key before the shuffle, without
    packing the other columns into an aggregation buffer.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").select(*keys, *rest)


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, distinct keys and rows a keep-last would remove."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
    )
