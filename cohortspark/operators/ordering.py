"""Exact ranks, running totals and quantiles without a one-task sort.

Running totals and full ranks work in two levels. Rows are put into value (or hash) buckets by
a deterministic expression; a small table holds the totals per bucket; a row's
running total is its bucket's offset plus a total inside the bucket. A group that
holds a third of all rows is therefore split over many buckets.

Where only the values at some ranks are asked for (quantiles, the cut of a split), they are found by
radix refinement of 64-bit numbers in the order of the values: four passes count rows by the next
16 bits below the prefixes that are still wanted. What leaves a task are counts, and after the first pass only
rows below a wanted prefix are read on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.hashing import draw_bucket, stable_draw
from cohortspark.session import cut_lineage

MOST_BUCKETS = 8192


def bucket_count(df: DataFrame) -> int:
    """Buckets for the session: a few per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(2 * parts, MOST_BUCKETS))


def value_cuts(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Cut points that split the rows of ``df`` evenly by ``key``.

    One aggregation with a bounded sketch; the answer is at most ``buckets``
    numbers, which become literals of the plan.
    """
    n = buckets or bucket_count(df)
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, probs, 4 * n).alias("q")).first()
    return sorted(set(row["q"] or []))


def with_bucket(df: DataFrame, key: str, cuts: list[float], out: str = "_bucket") -> DataFrame:
    """Add the index of the cut interval that holds ``key`` (binary search, JVM side)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *[float(c) for c in cuts], float("inf")]
    sized = Bucketizer(splits=splits, inputCol=key, outputCol="_b", handleInvalid="keep")
    return sized.transform(df).withColumn(out, F.col("_b").cast("int")).drop("_b")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"):
    """Join on equal keys where null matches null; the key columns appear once."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = eq if cond is None else cond & eq
    if cond is None:
        return left.crossJoin(renamed)  # right is one row: the totals of everything
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame, groups: list[str], key: str, sums: list[str], buckets: int | None = None
) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over rows of the group with a smaller key.

    ``df`` must hold one row per (group, key) and a non-null double ``key``. It is
    written out once, because the cut points, the bucket totals and the rows read it.
    """
    return _running(cut_lineage(df), groups, key, sums, buckets)


def _running(df, groups, key, sums, buckets=None) -> DataFrame:
    cut = with_bucket(df, key, value_cuts(df, key, buckets))
    return _two_level(cut, groups, [F.col(key)], sums)


def _two_level(cut: DataFrame, groups: list[str], order: list, sums: list[str]) -> DataFrame:
    totals = cut.groupBy(*groups, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    by = [F.col(g) for g in groups] or [F.lit(0)]
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(ahead), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*groups, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_i_{s}") for s in sums]
    )
    joined = null_safe_join(local, offsets, [*groups, "_bucket"])
    out = joined
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_i_{s}") + F.col(f"_o_{s}"))
    return out.drop("_bucket", *[f"_i_{s}" for s in sums], *[f"_o_{s}" for s in sums])


def hash_rank(
    df: DataFrame, ids: list[str], seed: int, groups: list[str] | None = None, bits: int = 8,
    out: str = "rank",
) -> DataFrame:
    """Add a zero-based shuffled position of each row (within ``groups``).

    The order is that of a keyed hash of ``ids``; ``2**bits`` hash buckets share
    the sort, so no task sees a whole group.
    """
    groups = groups or []
    drawn = (
        df.withColumn("_draw", stable_draw(seed, *ids))
        .withColumn("_bucket", draw_bucket(F.col("_draw"), bits))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    ranked = _two_level(drawn, groups, [F.col("_draw"), *[F.col(i) for i in ids]], ["_one"])
    return ranked.withColumnRenamed("before__one", out).drop("_draw", "_one")


# --- values at given ranks ------------------------------------------------------------------

def with_image(df: DataFrame, value: str, out: str = "_image") -> DataFrame:
    """Add the 64-bit number that orders as the doubles of ``value`` do; NaN is the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(value).to_numpy(zero_copy_only=False) + 0.0  # one zero
            bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits ^ (bits >> 63 & _MAGNITUDE))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def from_image(df: DataFrame, image: str, out: str) -> DataFrame:
    """Replace a 64-bit image by the double it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(image).to_numpy(zero_copy_only=False)
            v = (x ^ (x >> 63 & _MAGNITUDE)).view(np.float64)
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != image]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(v)], [*[n for n, _ in rest], out])

    kept = [f for f in df.schema.fields if f.name != image]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


_MAGNITUDE = np.int64(2**63 - 1)
STEP = 16  # bits of a pass


def select_ranks(
    rows: DataFrame, groups: list[str], image: str, n: str, ranks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """(groups, name, size, image, inside): the 64-bit ``image`` at zero-based ranks of each group.

    ``rows`` should be staged, as four passes read it; each row stands for ``n`` rows. ``ranks`` maps a name to the
    rank as a function of the group's size; ranks outside the group are left out. ``inside`` is the rank among the rows
    of that image.
    """
    asked = [
        F.struct(F.lit(name).alias("name"), at(F.col("_size")).cast("bigint").alias("at")) for name, at in ranks.items()
    ]
    key = [F.col(g) for g in groups] or [F.lit(0)]
    whole = Window.partitionBy(*key)
    ahead = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, F.shiftright(image, 64 - STEP).alias("_p")).agg(F.sum(n).alias("_c"))
    counts = counts.select(  # at most 2**STEP rows a group
        *groups, "_p", "_c", F.sum("_c").over(whole).alias("_size"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before")
    )
    here = F.filter(F.array(*asked), lambda r: (r["at"] >= F.col("_before")) & (r["at"] < F.col("_before") + F.col("_c")))
    found = counts.select(*groups, "_p", "_size", "_before", F.explode(here).alias("_r")).select(
        *groups, "_p", "_size", F.col("_r.name").alias("name"), (F.col("_r.at") - F.col("_before")).alias("_inside")
    )
    for left in range(64 - 2 * STEP, -1, -STEP):
        below = rows.select(*groups, n, F.shiftright(image, left).alias("_q"), F.shiftright(image, left + STEP).alias("_p"))
        # the ranks below a prefix travel with its counts, so that a pass reads the one before once
        wanted = found.groupBy(*groups, "_p", "_size").agg(F.collect_list(F.struct("name", "_inside")).alias("_r"))
        counts = null_safe_join(below, wanted, [*groups, "_p"]).groupBy(*groups, "_p", "_q", "_size", "_r").agg(F.sum(n).alias("_c"))
        ahead = Window.partitionBy(*groups, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        hit = F.filter("_r", lambda r: (r["_inside"] >= F.col("_before")) & (r["_inside"] < F.col("_before") + F.col("_c")))
        found = counts.select(*groups, F.col("_q").alias("_p"), "_size", "_before", F.explode(hit).alias("_h")).select(
            *groups, "_p", "_size", F.col("_h.name").alias("name"), (F.col("_h._inside") - F.col("_before")).alias("_inside")
        )
    return found.select(*groups, "name", F.col("_size").alias("size"), F.col("_p").alias("image"), F.col("_inside").alias("inside"))


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
    buckets: int | None = None, lower: bool = False,
) -> DataFrame:
    """Exact quantiles per group; linear interpolation unless ``lower``.

    Equal values collapse first; the values around each quantile come from ``select_ranks``, so neither rows nor
    values of a group meet in a task; ``buckets`` is taken for older callers and has no effect. ``probs`` maps output column names to probabilities. With ``lower`` the value
    at the floor position is taken, as a lower median does.
    """
    seen = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    seen = cut_lineage(with_image(seen, "_v").drop("_v"))
    pos = {name: (lambda size, p=p: F.lit(float(p)) * (size - 1)) for name, p in probs.items()}
    ranks = {f"lo_{name}": (lambda size, at=at: F.floor(at(size))) for name, at in pos.items()}
    if not lower:
        ranks |= {f"hi_{name}": (lambda size, at=at: F.ceil(at(size))) for name, at in pos.items()}
    found = from_image(select_ranks(seen, groups, "_image", "_n", ranks).drop("inside"), "image", "_v")
    picked = found.groupBy(*groups).agg(  # a few rows a group
        F.max("size").alias("_size"), *[F.max(F.when(F.col("name") == r, F.col("_v"))).alias(f"_{r}") for r in ranks]
    )
    cols = []
    for name, at in pos.items():
        lo = F.col(f"_lo_{name}")
        share = at(F.col("_size")) - F.floor(at(F.col("_size")))
        cols.append((lo if lower else lo + (F.col(f"_hi_{name}") - lo) * share).alias(name))
    return picked.select(*groups, *cols)


def cut_by_draw(
    df: DataFrame, ids: list[str], seed: int, cuts: dict[str, Callable[[Column], Column]], groups: list[str] | None = None,
) -> DataFrame:
    """Add a flag per cut: whether the row is among the first so many of its group in the shuffled order of ``ids``.

    ``cuts`` maps a flag's name to the number of rows as a function of the group's size. Only the draws at the cuts are looked for, no row gets
    a rank; rows that share the draw of a cut, if any, are told apart by their ids.
    """
    groups = groups or []
    drawn = cut_lineage(df.withColumn("_draw", stable_draw(seed, *ids)).withColumn("_one", F.lit(1).cast("bigint")))
    found = select_ranks(drawn.select(*groups, "_draw", "_one"), groups, "_draw", "_one", cuts)
    at = cut_lineage(found.groupBy(*groups).agg(  # two numbers per group and cut, which two branches below read
        *[F.max(F.when(F.col("name") == c, F.col(x))).alias(f"_{x}_{c}") for c in cuts for x in ("image", "inside")]
    ))
    # without a row at a cut the cut lies behind the last one
    joined = null_safe_join(drawn, at, groups, "left") if groups else drawn.join(F.broadcast(at), F.lit(True), "left")  # one row
    on_cut = F.lit(False)
    for c in cuts:
        on_cut = on_cut | F.coalesce(F.col("_draw") == F.col(f"_image_{c}"), F.lit(False))
    same = Window.partitionBy(*groups, "_draw").orderBy(*ids)
    rest = joined.filter(~on_cut).withColumn("_nth", F.lit(0))
    ties = joined.filter(on_cut).withColumn("_nth", F.row_number().over(same))
    draw = F.col("_draw")
    flags = {
        c: F.when(F.col(f"_image_{c}").isNull(), True).when(draw != F.col(f"_image_{c}"), draw < F.col(f"_image_{c}"))
        .otherwise(F.col("_nth") <= F.col(f"_inside_{c}"))
        for c in cuts
    }
    return rest.unionByName(ties).withColumns(flags).select(*df.columns, *cuts)
