"""From a processed dataset to split, normalized samples of one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.operators import cohort, grid, normalize, splits, windows


def prepare(
    spark: SparkSession, tables: dict[str, DataFrame], features: Sequence[str], path: str,
    seed: int = 42, ratios=C.SPLIT_RATIOS,
) -> dict[str, DataFrame]:
    """Write the patient split and the train statistics; both are read back if they still fit."""
    split = splits.reuse_or_split(spark, f"{path}/split", tables["static"], seed, ratios)
    assigned = splits.assign_split(tables["static"], split)
    splits.split_record(assigned, seed, ratios).write.mode("ignore").parquet(f"{path}/split")
    assigned = assigned.select("stay_id", "patient_id", "split")
    key = normalize.split_hash(assigned).first()["split_hash"]

    def compute():
        rows = grid.dense_to_rows(tables["timeseries"], features).join(
            assigned.select("stay_id", "split"), "stay_id"
        )
        return normalize.feature_stats(rows, features)

    stats = normalize.stored_or_computed(spark, f"{path}/stats", key, compute)
    return {"assigned": assigned, "stats": stats}


def samples(
    tables: dict[str, DataFrame], prepared: dict[str, DataFrame], task: str,
    fraction: float = 1.0, seed: int = 42, zscore: bool = True,
    window: int | None = None, train_stride: int | None = None,
) -> DataFrame:
    """Normalized series with label, split and safe static columns of one task.

    Statistics come from all train stays; the task's missing labels are dropped
    afterwards, then the train stays are cut to ``fraction`` of them. ``window`` cuts the
    series per split.
    """
    labelled = cohort.labelled_stays(tables["labels"], task).select(
        "stay_id", F.col(task).alias("label")
    )
    stays = prepared["assigned"].join(labelled, "stay_id")
    if fraction < 1.0:
        train = splits.label_fraction(stays.filter("split = 'train'").select("stay_id"), fraction, seed)
        stays = cohort.without_stays(stays, train.filter("not in_subset"))
    dense = normalize.normalize_dense(tables["timeseries"], prepared["stats"], zscore)
    out = dense.join(stays, "stay_id").join(cohort.safe_static(tables["static"]), "stay_id")
    if window is None:
        return out
    return windows.split_windows(out, window, train_stride or window // 2)
