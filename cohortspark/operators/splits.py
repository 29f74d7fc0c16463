"""Patient-level splits, label fractions and split provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.config import SPLIT_RATIOS
from cohortspark.operators.ordering import cut_by_draw
from cohortspark.session import cut_lineage

#: a key with no more rows than this is never worth a broadcast
MANY_ROWS = 100_000


def _check_ratios(ratios) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {ratios}")


def split_patients(stays: DataFrame, seed: int = 42, ratios=SPLIT_RATIOS) -> DataFrame:
    """(patient_id, split): shuffle the distinct patients, cut at ``int(n * ratio)``.

    The cuts are exact and need no global sort: only the two draws at the cuts are looked for.
    """
    _check_ratios(ratios)
    patients = stays.select(F.col("patient_id").cast("string").alias("patient_id")).distinct()
    n_train, n_val = (lambda n, r=r: F.floor(n * F.lit(r)) for r in ratios[:2])
    cut = cut_by_draw(patients, ["patient_id"], seed, {"_train": n_train, "_seen": lambda n: n_train(n) + n_val(n)})
    return cut.select("patient_id", F.when(F.col("_train"), "train").when(F.col("_seen"), "val").otherwise("test").alias("split"))


def assign_split(stays: DataFrame, split: DataFrame, strict: bool = True) -> DataFrame:
    """Give every stay its patient's split; with ``strict`` an unknown patient fails the job.

    A patient may own a large part of all stays; see ``skew_safe_lookup``.
    """
    keyed = stays.withColumn("patient_id", F.col("patient_id").cast("string"))
    out = skew_safe_lookup(keyed, split, "patient_id")
    if not strict:
        return out
    lost = F.raise_error(F.concat(F.lit("no split for patient "), "patient_id")).cast("string")
    return out.withColumn("split", F.coalesce(F.col("split"), lost))


def skew_safe_lookup(
    rows: DataFrame, table: DataFrame, key: str, share: float = 1e-3
) -> DataFrame:
    """Left join to a table with one row per key, with hot keys taken out of the shuffle.

    Keys that own more than ``share`` of the rows number fewer than ``1 / share``, so
    their table rows are broadcast and their many rows stay where they are. The other
    keys go through an ordinary join.
    """
    rows = cut_lineage(rows)  # the counts and both joins read it
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    heavy = counts.crossJoin(F.broadcast(total)).filter(  # one row: the total
        (F.col("_n") > F.col("_all") * share) & (F.col("_n") > MANY_ROWS)
    ).select(key)
    added = [c for c in table.columns if c != key]
    hot = heavy.join(table, key).withColumn("_hot", F.lit(True))  # fewer than 1 / share keys
    seen = rows.join(F.broadcast(hot), key, "left")
    few = seen.filter("_hot").drop("_hot")
    rest = seen.filter("_hot IS NULL").drop("_hot", *added).join(table, key, "left")
    return rest.unionByName(few)


def split_summary(assigned: DataFrame) -> DataFrame:
    """Stays and patients per split with realised shares of stays."""
    per = assigned.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_stays"), F.count_distinct("patient_id").alias("n_patients")
    )
    total = per.agg(F.sum("n_stays").alias("_n"))
    return per.crossJoin(F.broadcast(total)).select(
        "split", "n_stays", "n_patients", (F.col("n_stays") / F.col("_n")).alias("stay_share")
    )


def patient_is_stay(stays: DataFrame) -> DataFrame:
    """Leakage warning: every patient id equals its stay id."""
    same = F.col("patient_id").cast("string") == F.col("stay_id").cast("string")
    return stays.agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.coalesce(F.bool_and(same), F.lit(False)).alias("patient_equals_stay"),
    )


def task_split(assigned: DataFrame, labels: DataFrame, task: str) -> DataFrame:
    """Global split first, then the task's label filter; both views in one frame.

    ``in_task`` marks stays with a label; normalization uses all train stays.
    """
    marked = labels.select("stay_id", F.col(task).isNotNull().alias("in_task"))
    return assigned.join(marked, "stay_id", "left").withColumn(
        "in_task", F.coalesce(F.col("in_task"), F.lit(False))
    )


def label_fraction(stays: DataFrame, fraction: float, seed: int = 42, by: str | None = None):
    """Mark ``max(1, int(n * fraction))`` stays as ``in_subset``, the same ones per seed."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    keep = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
    return cut_by_draw(stays, ["stay_id"], seed, {"in_subset": keep}, [by] if by else [])


def split_record(assigned: DataFrame, seed: int, ratios=SPLIT_RATIOS) -> DataFrame:
    """The split as it is stored: ids, split, subset flag, seed and ratios."""
    subset = F.col("in_subset") if "in_subset" in assigned.columns else F.lit(None).cast("boolean")
    return assigned.select(
        "patient_id", "stay_id", "split", subset.alias("in_subset"),
        F.lit(seed).alias("seed"), F.array(*[F.lit(r) for r in ratios]).alias("ratios"),
    )


def cached_split_check(saved: DataFrame, stays: DataFrame, seed: int, ratios=SPLIT_RATIOS):
    """One row of the facts that decide whether a saved split may be used again."""
    per_patient = saved.groupBy("patient_id").agg(
        F.min("split").alias("a"), F.max("split").alias("b"),
        F.bool_and((F.col("seed") == seed) & (F.col("ratios") == F.array(*[F.lit(r) for r in ratios])))
        .alias("same_settings"),
    )
    current = stays.select(F.col("patient_id").cast("string").alias("patient_id")).distinct()
    both = per_patient.join(current.withColumn("now", F.lit(True)), "patient_id", "full")
    facts = both.agg(
        F.coalesce(F.bool_and("same_settings"), F.lit(False)).alias("same_settings"),
        F.count_if(F.col("a") != F.col("b")).alias("n_in_two_splits"),
        F.count_if(F.col("a").isNull()).alias("n_unsplit_patients"),
        F.count_if(F.col("now").isNull()).alias("n_gone_patients"),
        F.count_if(F.col("a") == "train").alias("n_train"),
        F.count_if(F.col("a") == "val").alias("n_val"),
        F.count_if(F.col("a") == "test").alias("n_test"),
    )
    ok = (
        F.col("same_settings") & (F.col("n_in_two_splits") == 0)
        & (F.col("n_unsplit_patients") == 0) & (F.col("n_gone_patients") == 0)
        & (F.col("n_train") > 0) & (F.col("n_val") > 0) & (F.col("n_test") > 0)
    )
    return facts.withColumn("reusable", ok)


def reuse_or_split(spark, path: str, stays: DataFrame, seed: int = 42, ratios=SPLIT_RATIOS):
    """Read the saved split when it still fits, else compute a new one."""
    from cohortspark.sources.tables import path_exists

    _check_ratios(ratios)
    if path_exists(spark, path):
        saved = spark.read.parquet(path)
        if cached_split_check(saved, stays, seed, ratios).first()["reusable"]:
            return saved.select("patient_id", "split").distinct()
    return split_patients(stays, seed, ratios)
