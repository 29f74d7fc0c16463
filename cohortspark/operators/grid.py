"""Dense grids: (hours x features) arrays per stay, and their long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.cohort import valid_hours
from cohortspark.operators.events import keep_last


def row_vectors(df: DataFrame, features: Sequence[str]) -> tuple[Column, Column]:
    """Value and mask arrays of one hour in feature order.

    An absent feature column reads as null / False; a False mask hides the value.
    """
    vals, masks = [], []
    for f in features:
        v = F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
        if f"{f}_mask" in df.columns:
            m = F.coalesce(F.col(f"{f}_mask"), F.lit(False)) & v.isNotNull()
        else:
            m = v.isNotNull()
        vals.append(F.when(m, v))
        masks.append(m)
    return F.array(*vals), F.array(*masks)


def one_per_hour(sparse: DataFrame) -> DataFrame:
    """One row per (stay, hour): of repeated hours the greatest row by its other columns.

    Rows have no order of their own, so without order columns this stands for the last one: the
    choice is the same on any partitioning. Each task keeps one row per hour before the shuffle.
    """
    rest = [c for c in sparse.columns if c not in ("stay_id", "hour")]
    return keep_last(sparse, ["stay_id", "hour"], rest) if rest else sparse.distinct()


def dense_grid(
    sparse: DataFrame, stays: DataFrame, features: Sequence[str], length: int,
    order: Sequence[str] | None = None, nan: bool = False, unique: bool = False,
) -> DataFrame:
    """One row per stay: ``timeseries`` and ``mask`` arrays of ``length`` hours.

    Hours outside ``[0, length)`` are dropped and repeated hours keep one row, the last by
    ``order`` or as in ``one_per_hour``. Both steps run on the (stay, hour) key, so what is
    collected per stay is bounded by ``length`` however many raw rows it has. Stays
    without rows stay in, all missing. ``nan`` writes missing cells as NaN; ``unique`` says that
    no hour repeats, as after binning, and saves the step.
    """
    rows = valid_hours(sparse, length)
    if not unique:
        rows = keep_last(rows, ["stay_id", "hour"], order) if order else one_per_hour(rows)
    vals, masks = row_vectors(rows, features)
    per_hour = rows.select("stay_id", F.col("hour").cast("int"), vals.alias("v"), masks.alias("m"))
    per_stay = per_hour.groupBy("stay_id").agg(
        F.map_from_entries(F.collect_list(F.struct("hour", F.struct("v", "m")))).alias("_h")
    )
    blank = F.lit(float("nan")) if nan else F.lit(None).cast("double")
    no_v = F.array(*[blank for _ in features])
    no_m = F.array(*[F.lit(False) for _ in features])
    hours = F.sequence(F.lit(0), F.lit(length - 1))
    cells = F.col("_h")

    def value_row(h):
        row = F.coalesce(cells[h]["v"], no_v)
        return F.transform(row, lambda x: F.coalesce(x, blank)) if nan else row

    return stays.select("stay_id").join(per_stay, "stay_id", "left").select(
        "stay_id",
        F.transform(hours, value_row).alias("timeseries"),
        F.transform(hours, lambda h: F.coalesce(cells[h]["m"], no_m)).alias("mask"),
    )


def grid_rows(
    sparse: DataFrame, stays: DataFrame, features: Sequence[str], length: int, unique: bool = False
) -> DataFrame:
    """Wide rows: every stay x hour with the sparse values, gaps as null / False."""
    return stay_hours(valid_hours(sparse, length), stays, features, F.lit(length), unique)


def stay_hours(
    sparse: DataFrame, stays: DataFrame, features: Sequence[str], hours: Column, unique: bool = False
) -> DataFrame:
    """Wide rows for hours ``0 .. hours - 1`` of each stay.

    Only the sparse rows are shuffled, by stay; the full grid is unfolded afterwards
    inside the task. The result stays partitioned by stay, so windows and groupings
    by stay need no further exchange. Repeated hours keep one row (``one_per_hour``), so
    what is collected per stay is bounded by its hours; ``unique`` says that none repeats.
    """
    if not unique:
        sparse = one_per_hour(sparse)
    rest = [c for c in sparse.columns if c not in ("stay_id", "hour")]
    cells = F.struct(F.col("hour").cast("int").alias("hour"), F.struct(*rest).alias("c"))
    per_stay = sparse.groupBy("stay_id").agg(
        F.map_from_entries(F.collect_list(cells)).alias("_h")
    )
    both = stays.select("stay_id", hours.cast("int").alias("_n")).filter(F.col("_n") > 0).join(
        per_stay, "stay_id", "left"
    )
    unfolded = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda h: F.struct(h.alias("hour"), F.col("_h")[h].alias("c")),
    )
    rows = both.select("stay_id", F.explode(unfolded).alias("_r"))
    masks = {f"{f}_mask" for f in features}
    return rows.select(
        "stay_id", "_r.hour",
        *[
            (F.coalesce(F.col(f"_r.c.{c}"), F.lit(False)) if c in masks else F.col(f"_r.c.{c}")).alias(c)
            for c in rest
        ],
    )


def check_grid_size(grid: DataFrame, stays: DataFrame, length: int) -> None:
    """Row-count guard: a grid has exactly stays x hours rows."""
    want = stays.count() * length
    got = grid.count()
    if got != want:
        raise ValueError(f"grid has {got} rows, expected {want}")


def resize(dense: DataFrame, length: int, n_features: int) -> DataFrame:
    """Cut or pad the hour axis to ``length`` (missing cells: null / False)."""
    no_v = F.array(*[F.lit(None).cast("double") for _ in range(n_features)])
    no_m = F.array(*[F.lit(False) for _ in range(n_features)])

    def fit(c, filler):
        gap = F.greatest(F.lit(length) - F.size(c), F.lit(0))
        return F.concat(F.slice(c, 1, length), F.array_repeat(filler, gap))

    return dense.withColumns(
        {"timeseries": fit("timeseries", no_v), "mask": fit("mask", no_m)}
    )


def length_range(dense: DataFrame) -> DataFrame:
    """Shortest and longest series; equal when the frame is uniform."""
    n = F.size("timeseries")
    return dense.agg(
        F.min(n).alias("min_len"), F.max(n).alias("max_len"),
        (F.min(n) == F.max(n)).alias("uniform"),
    )


def observed_cells(mask="mask") -> Column:
    """Number of True cells of a nested mask."""
    return F.aggregate(
        F.flatten(F.col(mask)), F.lit(0), lambda acc, x: acc + x.cast("int")
    )


def dense_to_rows(dense: DataFrame, features: Sequence[str]) -> DataFrame:
    """(stay, hour) rows with ``{f}`` and ``{f}_mask``; NaN becomes null."""
    rows = dense.select(
        "stay_id", F.posexplode(F.arrays_zip("timeseries", "mask")).alias("hour", "_c")
    )
    cols = []
    for i, f in enumerate(features):
        v = F.col("_c.timeseries")[i]
        cols += [F.when(~F.isnan(v), v).alias(f), F.col("_c.mask")[i].alias(f"{f}_mask")]
    return rows.select("stay_id", "hour", *cols)


def dense_to_long(dense: DataFrame, features: Sequence[str]) -> DataFrame:
    """(stay, hour, feature_name, value, observed) cells."""
    return wide_to_long(dense_to_rows(dense, features), features)


def wide_to_long(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Unpivot value/mask column pairs into cells."""
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature_name"),
                    F.col(f).cast("double").alias("value"),
                    F.coalesce(F.col(f"{f}_mask"), F.lit(False)).alias("observed"),
                )
                for f in features
            ]
        )
    )
    return rows.select("stay_id", "hour", cells.alias("_c")).select("stay_id", "hour", "_c.*")


def long_to_dense(
    cells: DataFrame, stays: DataFrame, features: Sequence[str], length: int
) -> DataFrame:
    """Inverse of ``dense_to_long``; unknown features and late hours are ignored."""
    known = valid_hours(cells.filter(F.col("feature_name").isin(*features)), length)
    aggs = []
    for f in features:
        mine = F.col("feature_name") == f
        aggs.append(F.max(F.when(mine & F.col("observed"), F.col("value"))).alias(f))
        aggs.append(F.coalesce(F.max(F.when(mine, F.col("observed"))), F.lit(False)).alias(f"{f}_mask"))
    return dense_grid(known.groupBy("stay_id", "hour").agg(*aggs), stays, features, length, unique=True)
