"""Cohort selection: filters, key subsets, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.functions import values as V
from cohortspark.functions.hashing import stable_draw


# --- stay filters -------------------------------------------------------------

def valid_los(stays: DataFrame) -> DataFrame:
    return stays.filter(F.col("los_days").isNotNull() & (F.col("los_days") >= 0))


def los_report(stays: DataFrame) -> DataFrame:
    """How many stays fail the length-of-stay rules."""
    los = F.col("los_days")
    return stays.agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.count_if(los.isNull()).alias("n_null_los"),
        F.count_if(los < 0).alias("n_negative_los"),
        F.count_if(los < C.MIN_STAY_HOURS / 24.0).alias("n_short"),
    )


def min_stay(stays: DataFrame, hours: float = C.MIN_STAY_HOURS) -> DataFrame:
    return stays.filter(F.col("los_days") >= hours / 24.0)


def drop_blocked(df: DataFrame, blocked: Sequence[str] = C.BLOCKED_FEATURES) -> DataFrame:
    return df.drop(*blocked, *[f"{b}_mask" for b in blocked])


def model_features(names: DataFrame, blocked: Sequence[str] = C.BLOCKED_FEATURES) -> DataFrame:
    """Feature names allowed as input, from a table of names."""
    return names.filter(~F.col("feature").isin(*blocked))


def discover_concepts(names: DataFrame, static_names: DataFrame) -> DataFrame:
    """Concepts that are neither static nor outcome names."""
    return names.join(static_names, "feature", "left_anti")


def observed_stays(dense: DataFrame) -> DataFrame:
    """Stays with at least one observed cell."""
    return dense.filter(F.exists("mask", lambda row: F.exists(row, lambda x: x)))


def valid_hours(sparse: DataFrame, length: int) -> DataFrame:
    return sparse.filter((F.col("hour") >= 0) & (F.col("hour") < length))


def hour_report(sparse: DataFrame, length: int) -> DataFrame:
    bad = (F.col("hour") < 0) | (F.col("hour") >= length)
    return sparse.agg(
        F.count_if(~bad).alias("n_valid"),
        F.count_if(bad).alias("n_overflow"),
        F.max("hour").alias("max_hour"),
    )


# --- projections --------------------------------------------------------------

def complete_columns(df: DataFrame, schema) -> DataFrame:
    """The schema's columns in order; absent ones as typed nulls."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def safe_static(static: DataFrame) -> DataFrame:
    """Only what a model may see: age and gender. Length of stay is withheld."""
    return static.select("stay_id", *[c for c in ("age", "gender") if c in static.columns])


def public_columns(df: DataFrame, internal=("config_json", "metrics")) -> DataFrame:
    return df.drop(*internal)


# --- predicates ---------------------------------------------------------------

def predicate(column: str, op: str, value) -> Column:
    """One comparison; ``between`` is half-open, as the samples need it."""
    c = F.col(column)
    ops = {
        "==": lambda: c == value,
        "!=": lambda: c != value,
        "<": lambda: c < value,
        ">": lambda: c > value,
        "<=": lambda: c <= value,
        ">=": lambda: c >= value,
        "in": lambda: c.isin(*value),
        "between": lambda: (c >= value[0]) & (c < value[1]),
    }
    if op not in ops:
        raise ValueError(f"unknown operator {op!r}; use one of {sorted(ops)}")
    if op == "between" and (not isinstance(value, tuple) or len(value) != 2):
        raise ValueError("between needs a (low, high) tuple")
    return ops[op]()


def run_matches(config_col: str, tags_col: str, prefix: str, wanted: Sequence[str]) -> Column:
    """Config value decides; without one the tag ``prefix:value`` does; no filter passes all."""
    if not wanted:
        return F.lit(True)
    tags = [f"{prefix}:{w}" for w in wanted]
    by_tag = F.exists(F.col(tags_col), lambda t: t.isin(*tags))
    return F.when(F.col(config_col).isNotNull(), F.col(config_col).isin(*wanted)).otherwise(
        F.coalesce(by_tag, F.lit(False))
    )


def benchmark_tasks(df: DataFrame, tasks: Sequence[str] = C.BENCHMARK_TASKS) -> DataFrame:
    return df.filter(F.col("task").isNull() | F.col("task").isin(*tasks))


def dropped_tasks(df: DataFrame, tasks: Sequence[str] = C.BENCHMARK_TASKS) -> DataFrame:
    gone = F.col("task").isNotNull() & ~F.col("task").isin(*tasks)
    return df.filter(gone).groupBy("task").agg(F.count(F.lit(1)).alias("n_dropped"))


# --- key subsets --------------------------------------------------------------

def only_stays(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed stays; frames without ``stay_id`` pass through."""
    if "stay_id" not in df.columns:
        return df
    return df.join(ids.select("stay_id"), "stay_id", "left_semi")


def without_stays(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("stay_id"), "stay_id", "left_anti")


def label_present(labels: DataFrame, task: str) -> Column:
    """A single label is set, or all columns of a multilabel task are."""
    cols = [task] if task in labels.columns else [
        c for c in labels.columns if c.startswith(f"{task}_")
    ]
    if not cols:
        raise ValueError(f"no label column for task {task!r}")
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def labelled_stays(labels: DataFrame, task: str, policy: str = "filter") -> DataFrame:
    """Rows with a label; policy ``raise`` refuses missing labels instead."""
    present = label_present(labels, task)
    if policy == "raise" and not labels.filter(~present).isEmpty():
        raise ValueError(f"missing labels for task {task!r}")
    return labels.filter(present)


def label_coverage(labels: DataFrame, task: str) -> DataFrame:
    present = label_present(labels, task)
    return labels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~present).alias("excluded"),
        (F.count_if(~present) * 100.0 / F.count(F.lit(1))).alias("excluded_pct"),
    )


def removed_samples(labels: DataFrame, task: str) -> DataFrame:
    """The log of stays a missing label removes."""
    gone = labels.filter(~label_present(labels, task))
    return gone.select("stay_id", F.lit(f"missing_{task}_label").alias("reason"))


# --- samples ------------------------------------------------------------------

def extreme_stays(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n lowest and n highest stays of a column (top-k in each task, then merged)."""
    seen = df.filter(F.col(column).isNotNull())
    low = seen.orderBy(F.col(column), "stay_id").limit(n)
    high = seen.orderBy(F.col(column).desc(), "stay_id").limit(n)
    return low.withColumn("extreme", F.lit("min")).unionByName(
        high.withColumn("extreme", F.lit("max"))
    )


def first_stays(df: DataFrame, n: int) -> DataFrame:
    return df.select("stay_id").orderBy("stay_id").limit(n)


def stratum(criteria: Sequence[C.Criterion]) -> Column:
    """Strata joined by ``_``; null when a row falls in none."""
    parts = []
    for c in criteria:
        if c.values is not None:
            parts.append(F.when(F.col(c.column).isin(*c.values), F.col(c.column).cast("string")))
        else:
            parts.append(V.cut_right_closed(c.column, c.edges, c.labels))
    all_set = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(all_set, F.concat_ws("_", *parts))


def sample_per_group(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """n rows per group by keyed hash.

    ``row_number() <= n`` lets Spark keep only n rows per group and task before the
    shuffle, so a huge group costs no more than a small one.
    """
    w = Window.partitionBy(group).orderBy("_draw", "stay_id")
    return (
        df.filter(F.col(group).isNotNull())
        .withColumn("_draw", stable_draw(seed, "stay_id"))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n)
        .drop("_draw", "_rn")
    )


def stratified_sample(
    df: DataFrame, criteria=C.DEFAULT_CRITERIA, n_per_stratum: int = 1, seed: int = 42
) -> DataFrame:
    usable = [c for c in criteria if c.column in df.columns]
    if not usable:
        drawn = df.withColumn("_draw", stable_draw(seed, "stay_id"))
        top = drawn.orderBy("_draw", "stay_id").limit(n_per_stratum * 8).drop("_draw")
        return top.withColumn("slot_name", F.lit("random"))
    return sample_per_group(df.withColumn("slot_name", stratum(usable)), "slot_name",
                            n_per_stratum, seed)


def missingness_sample(
    per_stay: DataFrame, n_per_bin: int = 3, seed: int = 42,
    edges=C.MISSINGNESS_EDGES, labels=C.MISSINGNESS_LABELS,
) -> DataFrame:
    binned = per_stay.withColumn(
        "missingness_bin", V.cut_right_closed("missingness_pct", edges, labels)
    )
    return sample_per_group(binned, "missingness_bin", n_per_bin, seed)


def select_slots(df: DataFrame, slots=C.DEFAULT_SLOTS, seed: int = 42) -> DataFrame:
    """One stay per slot, in slot order, never the same stay twice.

    Every slot's candidates come from one pass: a slot can lose at most as many
    stays as there are earlier slots, so its best ``i + 1`` rows are enough. The
    picks are then settled on that handful of rows. Slots that name a missing column
    are skipped; eight random stays stand in when no slot matches.
    """
    usable = [s for s in slots if all(c in df.columns for c, _, _ in s.filters)]
    ranked = []
    for i, s in enumerate(usable):
        cond = reduce(lambda a, b: a & b, [predicate(*f) for f in s.filters], F.lit(True))
        if s.sort_by and s.sort_by in df.columns:
            c = F.col(s.sort_by)
            order = c.desc_nulls_first() if s.descending else c.asc_nulls_first()
        else:
            order = stable_draw(seed + i, "stay_id").asc()
        best = df.filter(cond).orderBy(order, "stay_id").limit(i + 1)
        ranked.append(best.select("stay_id", F.lit(i).alias("slot"), order_rank(order)))
    picked: dict[int, int] = {}
    if ranked:
        rows = reduce(DataFrame.unionByName, ranked).collect()  # at most slots * (slots + 1) / 2
        for i in range(len(usable)):
            for r in sorted((r for r in rows if r["slot"] == i), key=lambda r: r["rn"]):
                if r["stay_id"] not in picked:
                    picked[r["stay_id"]] = i
                    break
    if not picked:
        top = df.withColumn("_draw", stable_draw(seed, "stay_id"))
        top = top.orderBy("_draw", "stay_id").limit(8).drop("_draw")
        return top.withColumn("slot_name", F.lit("fallback"))
    name = V.literal_map({stay: usable[i].name for stay, i in picked.items()})
    return df.filter(F.col("stay_id").isin(*picked)).withColumn("slot_name", name[F.col("stay_id")])


def order_rank(order: Column) -> Column:
    """Position inside a short, already limited frame."""
    w = Window.partitionBy(F.lit(0)).orderBy(order, "stay_id")
    return F.row_number().over(w).alias("rn")
