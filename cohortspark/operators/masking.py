"""Masks, noise and crops on cells and dense rows.

True means visible. Every draw is a keyed hash of the seed and the row's ids, so a
mask does not depend on partitioning and can be computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.hashing import stable_draw, stable_normal, stable_uniform
from cohortspark.functions.values import let
from cohortspark.operators.windows import seen_hours


# --- long cells -------------------------------------------------------------------

def cell_mask(cells: DataFrame, strategy: str, ratio: float, seed: int = 0) -> DataFrame:
    """``visible`` per cell: ``random``, ``timestep`` or ``feature`` draws.

    Unobserved cells are never masked.
    """
    ids = {
        "random": ("stay_id", "hour", "feature_name"),
        "timestep": ("stay_id", "hour"),
        "feature": ("stay_id", "feature_name"),
    }
    if strategy not in ids:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {sorted(ids)} or block")
    draw = stable_uniform(seed, F.lit(strategy), *ids[strategy])
    return cells.withColumn("visible", (draw >= ratio) | ~F.col("observed"))


def per_stay_ratio_mask(cells: DataFrame, ratio: str, seed: int = 0) -> DataFrame:
    """Cell mask whose ratio is a column of the stay."""
    draw = stable_uniform(seed, "stay_id", "hour", "feature_name")
    return cells.withColumn("visible", (draw >= F.col(ratio)) | ~F.col("observed"))


def fill_masked(cells: DataFrame, fill: float = 0.0) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("visible"), F.col("value")).otherwise(F.lit(fill)))


def add_noise(cells: DataFrame, std: float, seed: int = 0, out: str = "value") -> DataFrame:
    """Gaussian noise on the observed cells."""
    noise = stable_normal(seed, "stay_id", "hour", "feature_name") * F.lit(std)
    noisy = F.when(F.col("observed"), F.col("value") + noise).otherwise(F.col("value"))
    return cells.withColumn(out, noisy)


def two_views(cells: DataFrame, std: float, seed: int = 0) -> DataFrame:
    """Two independently noised copies of the value."""
    return add_noise(add_noise(cells, std, seed, "view_1"), std, seed + 1, "view_2")


def holdout(
    cells: DataFrame, strategy: str, ratio: float, n_features: int, length: int, seed: int = 0
) -> DataFrame:
    """``held_out`` observed cells for imputation scoring; their input value becomes 0.

    ``random`` draws cells, ``feature_block`` the same number of whole features per
    stay, ``temporal_block`` one run of hours per stay.
    """
    if strategy == "random":
        hit = stable_uniform(seed, "stay_id", "hour", "feature_name") < ratio
    elif strategy == "feature_block":
        # features ordered by a hash per stay; the first k of that order are held out
        k = max(1, int(n_features * ratio))
        names = cells.select("feature_name").distinct().agg(
            F.sort_array(F.collect_list("feature_name")).alias("_names")  # one row: the vocabulary
        )
        cells = cells.crossJoin(F.broadcast(names))
        order = F.sort_array(
            F.transform(
                "_names",
                lambda f: F.struct(stable_draw(seed, "stay_id", f).alias("h"), f.alias("f")),
            )
        )
        hit = F.exists(F.slice(order, 1, k), lambda s: s["f"] == F.col("feature_name"))
    elif strategy == "temporal_block":
        k = min(max(1, int(length * ratio)), length)
        start = F.floor(stable_uniform(seed, "stay_id") * max(1, length - k + 1))
        hit = (F.col("hour") >= start) & (F.col("hour") < start + k)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    marked = cells.withColumn("held_out", F.col("observed") & hit)
    out = marked.withColumn("input", F.when(F.col("held_out"), 0.0).otherwise(F.col("value")))
    return out.drop("_names")


# --- hour masks on dense rows ---------------------------------------------------------

def mask_budget(n_valid: Column, ratio: float) -> Column:
    """Hours to mask: rounded share, at least 1, leaving at least 1 visible."""
    asked = F.floor(n_valid * F.lit(ratio) + 0.5).cast("int")
    if ratio <= 0:
        return F.lit(0)
    return F.when(n_valid <= 1, 0).otherwise(F.least(F.greatest(asked, F.lit(1)), n_valid - 1))


def _valid_positions() -> Column:
    """Indices of the valid hours, in order."""
    flags = F.transform(F.col("_valid"), lambda v, i: F.when(v, i))
    return F.filter(flags, lambda i: i.isNotNull())


def _shuffled(arr: Column, seed: int, *ids) -> Column:
    """The items of a short array in keyed-hash order."""
    keyed = F.transform(arr, lambda x: F.struct(stable_draw(seed, *ids, x).alias("h"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def _hide(positions: Column) -> Column:
    """Visible flags of the row's hours with ``positions`` hidden."""
    return let(
        positions, lambda p: F.transform(F.col("_valid"), lambda v, i: ~F.array_contains(p, i))
    )


def _with_valid(dense: DataFrame) -> DataFrame:
    return dense.withColumn("_valid", seen_hours()).withColumn("_pos", _valid_positions())


def timestep_mask(dense: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """``visible`` hours with an exact masked budget over the valid hours."""
    df = _with_valid(dense)
    n = mask_budget(F.size("_pos"), ratio)
    picked = F.slice(_shuffled(F.col("_pos"), seed, "stay_id"), F.lit(1), n)
    return df.withColumn("visible", _hide(picked)).drop("_valid", "_pos")


def block_timestep_mask(
    dense: DataFrame, ratio: float, n_blocks: int = 3, seed: int = 0
) -> DataFrame:
    """Up to ``n_blocks`` separated runs of valid hours that meet the exact budget.

    The budget is cut into positive lengths at hashed cut points; the hours left are
    dealt to the gaps, one reserved between neighbours. Everything is an expression
    over the stay's own row.
    """
    df = _with_valid(dense).withColumn("_n", F.size("_pos"))
    df = df.withColumn("_m", mask_budget(F.col("_n"), ratio))
    wanted = F.least(F.lit(max(int(n_blocks), 1)), F.col("_m"), F.col("_n") - F.col("_m") + 1)
    df = df.withColumn("_k", F.greatest(wanted, F.lit(0)))
    key = (F.lit(seed), F.col("stay_id"))
    inner = F.when(F.col("_m") > 1, F.sequence(F.lit(1), F.col("_m") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    cuts = F.array_sort(F.slice(_shuffled(inner, seed, "stay_id"), F.lit(1), F.greatest(F.col("_k") - 1, F.lit(0))))
    df = df.withColumn("_ends", F.concat(cuts, F.array(F.col("_m"))))
    spare = F.col("_n") - F.col("_m") - (F.col("_k") - 1)
    df = df.withColumn("_spare", F.greatest(spare, F.lit(0)))
    # gap 0..k of each spare hour, by hash
    dealt = F.when(
        F.col("_spare") > 0,
        F.transform(
            F.sequence(F.lit(1), F.col("_spare")),
            lambda i: F.pmod(F.xxhash64(*key, F.lit("gap"), i), F.col("_k") + 1).cast("int"),
        ),
    ).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_dealt", dealt)
    # block j starts after the lengths of blocks < j, the j reserved hours, and gaps 0..j
    blocks = F.transform(
        F.col("_ends"),
        lambda end, j: F.struct(
            F.when(j > 0, F.col("_ends")[j - 1]).otherwise(0).alias("done"),
            end.alias("end"),
            (j + F.size(F.filter(F.col("_dealt"), lambda g: g <= j))).alias("shift"),
        ),
    )
    df = df.withColumn("_blocks", F.when(F.col("_m") > 0, blocks).otherwise(F.slice(blocks, 1, 0)))
    hidden = let(
        F.col("_blocks"),
        lambda blocks: F.filter(
            F.transform(
                F.col("_pos"),
                lambda p, o: F.when(
                    F.exists(
                        blocks,
                        lambda b: (o >= b["done"] + b["shift"]) & (o < b["end"] + b["shift"]),
                    ),
                    p,
                ),
            ),
            lambda p: p.isNotNull(),
        ),
    )
    keep = [*dense.columns, "visible"]
    return df.withColumn("visible", _hide(hidden)).select(*keep)


def contiguous_block_mask(
    dense: DataFrame, ratio: float, shortest: int = 3, longest: int = 10, seed: int = 0
) -> DataFrame:
    """Runs of 3 to 10 hours that cover up to ``int(T * ratio)`` hours, apart where possible.

    Block lengths fill the budget one after the other; each block takes the first
    free start in a hashed order of all starts, or any start when none is free.
    """
    key = (F.lit(seed), F.col("stay_id"))
    df = dense.withColumn("_T", F.size("mask"))
    df = df.withColumn("_budget", F.floor(F.col("_T") * F.lit(ratio)).cast("int"))

    def next_length(acc, i):
        left = F.col("_budget") - acc["total"]
        top = F.least(F.lit(longest), left)
        span = F.greatest(top - shortest + 1, F.lit(1))
        size = (shortest + F.pmod(F.xxhash64(*key, F.lit("len"), i), span)).cast("int")
        return F.when(
            (left > 0) & (top >= shortest),
            F.struct(
                (acc["total"] + size).cast("int").alias("total"),
                F.concat(acc["sizes"], F.array(size)).alias("sizes"),
            ),
        ).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.col("_budget") / shortest).cast("int"), F.lit(1)))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sizes"))
    df = df.withColumn("_sizes", F.aggregate(rounds, start, next_length)["sizes"])
    df = df.withColumn(
        "_starts", _shuffled(F.sequence(F.lit(0), F.col("_T") - 1), seed, "stay_id", F.lit("start"))
    )

    def place(acc, size, starts):
        def free(s):
            fits = s + size <= F.col("_T")
            clash = F.exists(acc, lambda b: (s < b["end"]) & (b["start"] < s + size))
            return fits & ~clash

        fallback = F.pmod(F.xxhash64(*key, F.lit("any"), F.size(acc)), F.col("_T") - size + 1)
        first = F.coalesce(F.filter(starts, free)[0], fallback.cast("int"))
        block = let(first, lambda f: F.struct(f.alias("start"), (f + size).alias("end")))
        return F.concat(acc, F.array(block))

    none = F.array().cast("array<struct<start:int,end:int>>")
    placed = let(
        F.col("_starts"),
        lambda starts: F.aggregate("_sizes", none, lambda acc, size: place(acc, size, starts)),
    )
    visible = let(
        placed,
        lambda blocks: F.transform(
            F.sequence(F.lit(0), F.col("_T") - 1),
            lambda h: ~F.exists(blocks, lambda b: (h >= b["start"]) & (h < b["end"])),
        ),
    )
    return df.withColumn("visible", visible).select(*dense.columns, "visible")


def complementary_views(masked: DataFrame) -> DataFrame:
    """``visible`` and ``visible_2`` over the valid hours, neither ever empty.

    No valid hour: both all visible in the second, first as is. One valid hour: seen
    in both. Otherwise complements; a second view with nothing takes the first
    visible hour of the first view.
    """
    df = _with_valid(masked).withColumn("_n", F.size("_pos"))
    only = F.col("_pos")[0]
    hidden_valid = F.exists(
        F.arrays_zip("visible", "_valid"), lambda c: ~c["visible"] & c["_valid"]
    )
    moved = F.when((F.col("_n") >= 2) & ~hidden_valid, only)  # all valid hours are visible
    df = df.withColumn("_moved", moved)
    first = F.transform(
        F.col("visible"),
        lambda v, i: F.when((F.col("_n") == 1) & (i == only), True)
        .when(F.coalesce(i == F.col("_moved"), F.lit(False)), False)
        .otherwise(v),
    )
    second = F.transform(
        F.col("visible"),
        lambda v, i: F.when(F.col("_n") == 0, True)
        .when((F.col("_n") == 1) & (i == only), True)
        .when(F.coalesce(i == F.col("_moved"), F.lit(False)), True)
        .otherwise(~v | ~F.col("_valid")[i]),
    )
    return df.withColumns({"visible": first, "visible_2": second}).select(
        *masked.columns, "visible_2"
    )


def view_counts(views: DataFrame) -> DataFrame:
    """Mean visible and masked valid hours per stay in both views."""
    df = views.withColumn("_valid", seen_hours())

    def per(view, shown):
        pairs = F.arrays_zip(F.col(view).alias("v"), F.col("_valid").alias("ok"))
        return F.size(F.filter(pairs, lambda c: c["ok"] & (c["v"] if shown else ~c["v"])))

    return df.agg(
        F.avg(per("visible", True)).alias("n_visible_view1"),
        F.avg(per("visible_2", True)).alias("n_visible_view2"),
        F.avg(per("visible", False)).alias("n_masked_view1"),
        F.avg(per("visible_2", False)).alias("n_masked_view2"),
    )


def token_mask(tokens: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """``visible`` per token; a stay with tokens keeps at least one visible."""
    flags = F.transform(
        "tokens",
        lambda t, i: (stable_uniform(seed, F.col("stay_id"), i) >= ratio) | t.isNull(),
    )
    df = tokens.withColumn("visible", flags)
    none = ~F.exists(
        F.arrays_zip("tokens", "visible"), lambda c: c["visible"] & c["tokens"].isNotNull()
    )
    fixed = let(none, lambda n: F.transform("visible", lambda v, i: v | (n & (i == 0))))
    return df.withColumn("visible", fixed)


def visible_steps(masked: DataFrame) -> DataFrame:
    """``steps``: (hour, values) of the visible valid hours, in order."""
    df = masked.withColumn("_valid", seen_hours())
    rows = F.transform(
        F.arrays_zip("timeseries", "visible", "_valid"),
        lambda c, i: F.struct(
            i.alias("hour"), c["timeseries"].alias("values"),
            (c["visible"] & c["_valid"]).alias("keep"),
        ),
    )
    kept = F.transform(
        F.filter(rows, lambda s: s["keep"]), lambda s: F.struct(s["hour"], s["values"])
    )
    return df.withColumn("steps", kept).drop("_valid")


def scatter_steps(df: DataFrame, length: int, n_features: int, fill: float = 0.0) -> DataFrame:
    """Put ``steps`` back on the full grid, other hours at ``fill``."""
    blank = F.array(*[F.lit(fill).cast("double") for _ in range(n_features)])
    full = let(
        F.map_from_entries(F.col("steps")),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(length - 1)), lambda h: F.coalesce(m[h], blank)
        ),
    )
    return df.withColumn("timeseries", full)


def shared_crop(dense: DataFrame, ratio: float, length: int, seed: int = 0) -> DataFrame:
    """The same hashed sub-interval of ``max(2, int(T * ratio))`` hours from every stay."""
    size = min(max(2, int(length * ratio)), length)
    start = F.floor(stable_uniform(seed, F.lit("crop")) * (length - size + 1)).cast("int")
    return dense.withColumns(
        {
            "crop_start": start,
            "timeseries": F.slice("timeseries", start + 1, F.lit(size)),
            "mask": F.slice("mask", start + 1, F.lit(size)),
        }
    )
