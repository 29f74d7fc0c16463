"""Registered queries: grids, windows, features, normalization, masks, missingness."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import cohort as CO
from cohortspark.operators import grid as GR
from cohortspark.operators import masking as K
from cohortspark.operators import metrics as ME
from cohortspark.operators import missingness as D
from cohortspark.operators import normalize as N
from cohortspark.operators import windows as WI
from cohortspark.plans import analogs as A
from cohortspark.plans.queries_cohort import r6, split_stays
from cohortspark.plans.registry import CTES, query
from cohortspark.plans.registry import with_tables as W
from cohortspark.session import cut_lineage

T = 48  # hours of the grids below
FE = A.FEATURES


def dense(spark, sf, length=T):
    return GR.dense_grid(A.hourly(spark, sf), A.stays(spark, sf), FE, length, unique=True)


def grid(spark, sf, length=T):
    return GR.grid_rows(A.hourly(spark, sf), A.stays(spark, sf), FE, length, unique=True)


def cells(spark, sf, length=T):
    return GR.wide_to_long(grid(spark, sf, length), FE)


def _grid_sql(length):
    masks = ", ".join(f"coalesce({f}_mask, false) AS {f}_mask" for f in FE)
    vals = ", ".join(FE)
    return f"""SELECT stay_id, hour, {vals}, {masks} FROM
 (SELECT stay_id, CAST(unnest(range({length})) AS INTEGER) AS hour FROM stays) LEFT JOIN hourly USING (stay_id, hour)"""


CTES["grid"] = _grid_sql(T)
CTES["gridw"] = _grid_sql(A.HOURS)
CTES["cell"] = " UNION ALL ".join(
    f"SELECT stay_id, hour, '{f}' AS feature_name, {i} AS d, {f}::DOUBLE AS value, {f}_mask AS observed FROM grid"
    for i, f in enumerate(FE)
)
_G = "ev cleaned hourly stays grid"
_C = _G + " cell"
_SEEN = " + ".join(f"CAST({f}_mask AS INTEGER)" for f in FE)
_ANY = " OR ".join(f"{f}_mask" for f in FE)
_AGG = "round(sum(value), 4) AS total, count(value) AS n_values, count(*) FILTER (observed) AS n_observed, count(*) AS n_cells"


def cell_totals(df, *by):
    return df.groupBy(*by).agg(
        F.round(F.sum("value"), 4).alias("total"), F.count("value").alias("n_values"),
        F.count_if("observed").alias("n_observed"), F.count(F.lit(1)).alias("n_cells"),
    )


# --- grids --------------------------------------------------------------------------------

@query("dense_grid", W(_C, "SELECT stay_id, hour, feature_name, round(value, 6) AS value, observed FROM cell"))
def dense_grid(spark, sf):
    return r6(GR.dense_to_long(dense(spark, sf), FE), "value")


@query("dense_grid_nan", W(_C, """
SELECT feature_name, count(*) FILTER (value IS NULL) AS n_nan, round(sum(value), 4) AS total FROM cell GROUP BY 1"""))
def dense_grid_nan(spark, sf):
    g = GR.dense_grid(A.hourly(spark, sf), A.stays(spark, sf), FE, T, nan=True, unique=True)
    rows = g.select(F.explode("timeseries").alias("row")).select(
        F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in FE]).alias("feature_name"), F.col("row").alias("v"))).alias("c")
    )
    return rows.groupBy(F.col("c.feature_name").alias("feature_name")).agg(
        F.count_if(F.isnan("c.v")).alias("n_nan"),
        F.round(F.sum(F.when(~F.isnan("c.v"), F.col("c.v"))), 4).alias("total"),
    )


@query("grid_rows", W(_G, f"SELECT stay_id, hour, error, purchase, {', '.join(f + '_mask' for f in FE)} FROM grid"))
def grid_rows(spark, sf):
    return grid(spark, sf).select("stay_id", "hour", "error", "purchase", *[f"{f}_mask" for f in FE])


@query("grid_deduplicated", W("ev stays", f"""
SELECT stay_id, hour, v AS value FROM (SELECT stay_id, CAST(unnest(range({T})) AS INTEGER) AS hour FROM stays)
LEFT JOIN (SELECT stay_id, hour, arg_max(value, (ts, event_id)) AS v FROM ev GROUP BY 1, 2) USING (stay_id, hour)"""))
def grid_deduplicated(spark, sf):
    raw = A.raw_events(spark, sf).select("stay_id", "hour", "value", "ts", "event_id")
    g = GR.dense_grid(raw, A.stays(spark, sf), ["value"], T, order=("ts", "event_id"))
    return GR.dense_to_rows(g, ["value"]).drop("value_mask")


@query("resized_grid", W("ev cleaned hourly stays grid cell", """
SELECT stay_id, count(*) AS n_cells, count(*) FILTER (observed) AS n_observed, round(sum(value), 4) AS total FROM
 (SELECT stay_id, hour, observed, value FROM cell WHERE hour < 24 UNION ALL
  SELECT stay_id, hour + 1000, false, NULL FROM cell WHERE hour < 16) GROUP BY stay_id"""))
def resized_grid(spark, sf):
    """Cut to 24 hours, then pad to 40."""
    g = GR.resize(GR.resize(dense(spark, sf), 24, len(FE)), 40, len(FE))
    long = GR.dense_to_long(g, FE)
    return cell_totals(long, "stay_id").select("stay_id", "n_cells", "n_observed", "total")


@query("length_range", W("ev stays", f"SELECT {T} AS min_len, {T} AS max_len, true AS uniform FROM stays LIMIT 1"))
def length_range(spark, sf):
    return GR.length_range(dense(spark, sf))


@query("observed_cells", W(_G, f"SELECT stay_id, CAST(sum({_SEEN}) AS INTEGER) AS n_observed FROM grid GROUP BY stay_id"))
def observed_cells(spark, sf):
    return dense(spark, sf).select("stay_id", GR.observed_cells().alias("n_observed"))


@query("observed_stays", W(_G, f"SELECT stay_id FROM grid GROUP BY stay_id HAVING sum({_SEEN}) > 0"))
def observed_stays(spark, sf):
    return CO.observed_stays(dense(spark, sf)).select("stay_id")


@query("dense_to_rows", W(_G, "SELECT stay_id, hour, error, error_mask, purchase, purchase_mask FROM grid WHERE error_mask OR purchase_mask"))
def dense_to_rows(spark, sf):
    rows = GR.dense_to_rows(dense(spark, sf), FE)
    return rows.filter("error_mask or purchase_mask").select(
        "stay_id", "hour", "error", "error_mask", "purchase", "purchase_mask"
    )


@query("wide_to_long", W("ev cleaned hourly", " UNION ALL ".join(
    f"SELECT '{f}' AS feature_name, count(*) FILTER ({f}_mask) AS n_observed, round(sum({f})::DOUBLE, 4) AS total FROM hourly" for f in FE)))
def wide_to_long(spark, sf):
    long = GR.wide_to_long(A.hourly(spark, sf), FE)
    return cell_totals(long, "feature_name").select("feature_name", "n_observed", "total")


@query("long_to_dense", W("ev", f"""
SELECT stay_id, hour, max(value) FILTER (label = 'click') AS click, max(value) FILTER (label = 'view') AS view
FROM ev WHERE hour < {T} AND label IN ('click', 'view') GROUP BY 1, 2"""))
def long_to_dense(spark, sf):
    """Cells of known and unknown features to arrays and back; only observed hours are kept."""
    long = A.raw_events(spark, sf).select(
        "stay_id", "hour", F.col("label").alias("feature_name"), "value", F.lit(True).alias("observed")
    )
    g = GR.long_to_dense(long, A.stays(spark, sf), ["click", "view"], T)
    rows = GR.dense_to_rows(g, ["click", "view"])
    return rows.filter("click_mask or view_mask").select("stay_id", "hour", "click", "view")


# --- windows and gaps ------------------------------------------------------------------------

CTES["alen"] = f"SELECT stay_id, coalesce(max(hour) FILTER ({_ANY}) + 1, 0) AS len FROM gridw GROUP BY stay_id"
CTES["win"] = """
SELECT stay_id, CAST(s AS INTEGER) AS window_start FROM alen, unnest(range(0, 168 - 24 + 1, 12)) AS u(s) WHERE s < len"""
_W = "ev cleaned hourly stays gridw alen win"


@query("actual_length", W("ev cleaned hourly stays gridw alen", "SELECT stay_id, len FROM alen"))
def actual_length(spark, sf):
    return dense(spark, sf, A.HOURS).select("stay_id", WI.actual_length().alias("len"))


@query("sliding_windows", W(_W, f"""
SELECT w.stay_id, w.window_start, w.window_start // 12 AS window_idx, count(*) AS n_hours, CAST(sum({_SEEN}) AS BIGINT) AS n_observed,
  round(coalesce(sum(view), 0), 4) AS view_total
FROM win w JOIN gridw g ON g.stay_id = w.stay_id AND g.hour >= w.window_start AND g.hour < w.window_start + 24 GROUP BY 1, 2, 3"""))
def sliding_windows(spark, sf):
    win = WI.sliding_windows(dense(spark, sf, A.HOURS), 24)
    at = FE.index("view")
    total = F.aggregate(
        F.transform("timeseries", lambda r: F.coalesce(r[at], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
    )
    return win.select(
        "stay_id", "window_start", "window_idx", F.size("timeseries").cast("bigint").alias("n_hours"),
        GR.observed_cells().cast("bigint").alias("n_observed"), F.round(total, 4).alias("view_total"),
    )


@query("window_count_stats", W(_W, """
SELECT min(n) AS min_windows, max(n) AS max_windows, round(avg(n), 6) AS mean_windows,
  CAST(sum(n) AS BIGINT) AS total_windows, count(*) AS n_stays FROM (SELECT count(*) AS n FROM win GROUP BY stay_id)"""))
def window_count_stats(spark, sf):
    return r6(WI.window_count_stats(WI.sliding_windows(dense(spark, sf, A.HOURS), 24)), "mean_windows")


@query("split_windows", W("ev cleaned hourly stays gridw alen split", """
SELECT split, count(*) AS n_windows, count(DISTINCT stay_id) AS n_stays, CAST(sum(s) AS BIGINT) AS start_sum FROM (
 SELECT stay_id, split, s FROM alen JOIN stays USING (stay_id) JOIN split USING (patient_id), unnest(range(0, 145, 6)) AS u(s) WHERE split = 'train' AND s < len
 UNION ALL SELECT stay_id, split, s FROM alen JOIN stays USING (stay_id) JOIN split USING (patient_id), unnest(range(0, 145, 24)) AS u(s) WHERE split = 'val' AND s < len
 UNION ALL SELECT stay_id, split, 0 FROM stays JOIN split USING (patient_id) WHERE split = 'test') GROUP BY split"""))
def split_windows(spark, sf):
    marked = dense(spark, sf, A.HOURS).join(split_stays(spark, sf).select("stay_id", "split"), "stay_id")
    return WI.split_windows(marked, 24, 6).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("stay_id").alias("n_stays"),
        F.sum("window_start").alias("start_sum"),
    )


_PAST = "OVER (PARTITION BY stay_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("time_since_observed", W(_G, f"""
SELECT stay_id, hour, hour - coalesce(max(hour) FILTER (click_mask) {_PAST}, 0) AS click_delta,
  hour - coalesce(max(hour) FILTER (error_mask) {_PAST}, 0) AS error_delta FROM grid"""))
def time_since_observed(spark, sf):
    out = WI.time_since_observed(grid(spark, sf), ["click", "error"])
    return out.select("stay_id", "hour", "click_delta", "error_delta")


@query("last_observed", W(_G, f"""
SELECT stay_id, hour, coalesce(last_value(error IGNORE NULLS) {_PAST}, 50.0) AS error_last,
  coalesce(last_value(purchase IGNORE NULLS) {_PAST}, 40.0) AS purchase_last FROM grid"""))
def last_observed(spark, sf):
    out = WI.last_observed(grid(spark, sf), ["error", "purchase"], {"error": 50.0, "purchase": 40.0})
    return out.select("stay_id", "hour", "error_last", "purchase_last")


@query("first_last_observed", W(_C, """
SELECT stay_id, feature_name, round(arg_min(value, hour), 6) AS first_value, round(arg_max(value, hour), 6) AS last_value,
  min(hour) AS first_hour, max(hour) AS last_hour FROM cell WHERE observed GROUP BY 1, 2"""))
def first_last_observed(spark, sf):
    return r6(WI.first_last_observed(cells(spark, sf)), "first_value", "last_value")


@query("observed_tokens", W(_C, """
SELECT stay_id, CAST(row_number() OVER (PARTITION BY stay_id ORDER BY hour, d) - 1 AS INTEGER) AS pos, hour AS timestep, d AS feature,
  round(value, 6) AS value FROM cell WHERE observed"""))
def observed_tokens(spark, sf):
    t = WI.observed_tokens(dense(spark, sf))
    return t.select("stay_id", F.posexplode("tokens").alias("pos", "t")).select(
        "stay_id", "pos", "t.timestep", "t.feature", F.round("t.value", 6).alias("value")
    )


@query("padded_tokens", W(_C, """
SELECT stay_id, count(*) FILTER (observed) AS n_obs, greatest(count(*) FILTER (observed), 12) AS n_slots FROM cell GROUP BY stay_id"""))
def padded_tokens(spark, sf):
    t = WI.observed_tokens(dense(spark, sf), most=12)
    return t.select("stay_id", F.col("n_obs").cast("bigint").alias("n_obs"),
                    F.size("tokens").cast("bigint").alias("n_slots"))


@query("seen_hours", W(_G, f"SELECT stay_id, hour FROM grid WHERE {_ANY}"))
def seen_hours(spark, sf):
    flags = dense(spark, sf).select("stay_id", F.posexplode(WI.seen_hours()).alias("hour", "seen"))
    return flags.filter("seen").select("stay_id", "hour")


@query("pooled_mean", W(_G, f"""
SELECT stay_id, round(coalesce(avg(coalesce(view, 0)) FILTER ({_ANY}), 0), 6) AS view,
  round(coalesce(avg(coalesce(error, 0)) FILTER ({_ANY}), 0), 6) AS error FROM grid GROUP BY stay_id"""))
def pooled_mean(spark, sf):
    return r6(WI.pool_hours(grid(spark, sf), FE, "mean").select("stay_id", "view", "error"), "view", "error")


@query("pooled_last_first_max", W(_G, f"""
SELECT stay_id, coalesce(arg_max(coalesce(error, 0), hour) FILTER ({_ANY}), 0) AS last_error,
  coalesce(arg_min(coalesce(error, 0), hour) FILTER ({_ANY}), 0) AS first_error,
  coalesce(max(coalesce(error, 0)) FILTER ({_ANY}), 0) AS max_error FROM grid GROUP BY stay_id"""))
def pooled_last_first_max(spark, sf):
    g = grid(spark, sf)
    out = None
    for how in ("last", "first", "max"):
        p = WI.pool_hours(g, FE, how).select("stay_id", F.col("error").alias(f"{how}_error"))
        out = p if out is None else out.join(p, "stay_id")
    return out


_STATS = {
    "mean": "avg({f})", "std": "stddev_pop({f})", "min": "min({f})", "max": "max({f})",
    "first": "arg_min({f}, hour) FILTER ({f}_mask)", "last": "arg_max({f}, hour) FILTER ({f}_mask)",
    "obs_count": f"count({{f}})::DOUBLE", "obs_frac": f"count({{f}}) / {T}.0",
}


@query("tabular_summary", W(_G, "SELECT stay_id, " + ", ".join(
    f"round(coalesce({e.format(f=f)}, 0.0)::DOUBLE, 6) AS {f}__{s}" for f in FE for s, e in _STATS.items()
) + " FROM grid GROUP BY stay_id"))
def tabular_summary(spark, sf):
    out = WI.tabular_summary(grid(spark, sf), FE, T)
    return r6(out, *[c for c in out.columns if c != "stay_id"])


@query("tabular_vector", W(_G, "SELECT stay_id, i AS pos, round(x, 6) AS x FROM (SELECT stay_id, ["
    + ", ".join(f"coalesce({e.format(f=f)}, 0.0)::DOUBLE" for f in FE[:2] for s, e in _STATS.items())
    + "] AS v FROM grid GROUP BY stay_id), LATERAL (SELECT CAST(unnest(range(16)) AS INTEGER) AS i, unnest(v) AS x)"))
def tabular_vector(spark, sf):
    v = WI.tabular_vector(grid(spark, sf), FE[:2], T)
    return v.select("stay_id", F.posexplode("features").alias("pos", "x")).withColumn("x", F.round("x", 6))


# --- normalization ------------------------------------------------------------------------------

def train_rows(spark, sf, binned=None):
    """The observed hours with their split; hours without an observed cell add nothing to a statistic."""
    hours = CO.valid_hours(A.hourly(spark, sf) if binned is None else binned, T)
    return hours.join(split_stays(spark, sf).select("stay_id", "split"), "stay_id")


def stats(spark, sf, policy="repair", binned=None):
    return N.feature_stats(train_rows(spark, sf, binned), FE, policy)


def _stats_sql(std):
    return " UNION ALL ".join(
        f"SELECT {i} AS feature_idx, '{f}' AS feature, coalesce(avg({f}), 0.0) AS mean, {std.format(f=f)} AS std, count({f}) AS n_obs FROM traing"
        for i, f in enumerate(FE)
    )


CTES["traing"] = "SELECT g.* FROM grid g JOIN stays USING (stay_id) JOIN split USING (patient_id) WHERE split = 'train'"
CTES["fstats"] = _stats_sql("CASE WHEN coalesce(stddev_samp({f}), 0) <= 1e-6 THEN 1.0 ELSE stddev_samp({f}) END")
CTES["fclamp"] = _stats_sql("CASE WHEN count({f}) <= 1 THEN 1.0 ELSE greatest(stddev_samp({f}), 1e-6) END")
_N = _G + " split traing fstats"


@query("normalization_stats", W(_N, "SELECT feature_idx, feature, round(mean, 8) AS mean, round(std, 8) AS std, n_obs FROM fstats"))
def normalization_stats(spark, sf):
    return stats(spark, sf).withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@query("normalization_stats_clamped", W(_G + " split traing fclamp", "SELECT feature_idx, feature, round(mean, 8) AS mean, round(std, 8) AS std, n_obs FROM fclamp"))
def normalization_stats_clamped(spark, sf):
    return stats(spark, sf, "clamp").withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@query("normalized_grid", W(_N + " cell", """
SELECT stay_id, hour, feature_name, round(CASE WHEN observed THEN (value - mean) / std ELSE 0.0 END, 5) AS value
FROM cell JOIN fstats ON feature = feature_name"""))
def normalized_grid(spark, sf):
    binned = cut_lineage(A.hourly(spark, sf))  # read for the statistics and for the grid
    wide = GR.dense_grid(binned, A.stays(spark, sf), FE, T, unique=True)
    done = N.normalize_dense(wide, stats(spark, sf, binned=binned))
    long = GR.dense_to_long(done, FE)
    return long.select("stay_id", "hour", "feature_name", F.round("value", 5).alias("value"))


@query("normalized_rows", W(_N, """
SELECT stay_id, hour, round(coalesce((error - (SELECT mean FROM fstats WHERE feature = 'error')) / (SELECT std FROM fstats WHERE feature = 'error'), 0.0), 5) AS error
FROM grid"""))
def normalized_rows(spark, sf):
    binned = cut_lineage(A.hourly(spark, sf))  # read for the statistics and for the grid
    rows = GR.grid_rows(binned, A.stays(spark, sf), FE, T, unique=True)
    out = N.normalize_rows(rows, stats(spark, sf, binned=binned), FE)
    return out.select("stay_id", "hour", F.round("error", 5).alias("error"))


@query("normalized_features", W(_N + " cell", """
SELECT stay_id, hour, max(v) FILTER (feature = 'click') AS click, max(v) FILTER (feature = 'error') AS error, max(v) FILTER (feature = 'purchase') AS purchase,
  max(v) FILTER (feature = 'signup') AS signup, max(v) FILTER (feature = 'view') AS view
FROM (SELECT stay_id, hour, feature, round(CASE WHEN observed THEN (value - mean) / std ELSE 0.0 END, 5) AS v FROM cell JOIN fstats ON feature = feature_name)
GROUP BY stay_id, hour"""))
def normalized_features(spark, sf):
    """Wide rows of all features, binned once."""
    binned = cut_lineage(A.hourly(spark, sf))
    rows = GR.grid_rows(binned, A.stays(spark, sf), FE, T, unique=True)
    out = N.normalize_rows(rows, stats(spark, sf, binned=binned), FE)
    return out.select("stay_id", "hour", *[F.round(f, 5).alias(f) for f in FE])


@query("merged_normalization_stats", W(_N, "SELECT feature_idx, feature, round(mean, 8) AS mean, round(std, 8) AS std, n_obs FROM fstats"))
def merged_normalization_stats(spark, sf):
    """The statistics of the train stays from states per patient: parts add up to the whole."""
    rows = train_rows(spark, sf).filter("split = 'train'").withColumn("part", F.pmod(F.xxhash64("stay_id"), F.lit(7)))
    states = N.feature_states(rows, FE, by=["part"]).drop("part")
    return N.stats_of(N.merged_states(states)).withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@query("mean_imputed_grid", W(_N + " cell", """
SELECT feature_name, count(*) AS n, round(avg(coalesce(value, mean)), 5) AS mean_value FROM cell JOIN fstats ON feature = feature_name GROUP BY 1"""))
def mean_imputed_grid(spark, sf):
    done = N.normalize_dense(dense(spark, sf), stats(spark, sf), zscore=False)
    long = GR.dense_to_long(done, FE)
    return long.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean_value")
    )


@query("inspect_stay", W(_N + " cell", """
SELECT hour, feature_name, round(value, 5) AS raw, round(CASE WHEN observed THEN (value - mean) / std ELSE 0.0 END, 5) AS normalized
FROM cell JOIN fstats ON feature = feature_name WHERE stay_id = (SELECT min(stay_id) FROM stays)"""))
def inspect_stay(spark, sf):
    first = A.raw_events(spark, sf).agg(F.min("stay_id").alias("m")).first()["m"]
    one = N.inspect_stay(dense(spark, sf), stats(spark, sf), first)
    zipped = F.arrays_zip(
        F.flatten("grid").alias("raw"), F.flatten("normalized").alias("normalized")
    )
    rows = one.select(F.posexplode(zipped).alias("i", "c"))
    names = F.array(*[F.lit(f) for f in FE])
    return rows.select(
        F.floor(F.col("i") / len(FE)).cast("int").alias("hour"),
        F.get(names, F.col("i") % len(FE)).alias("feature_name"),
        F.round("c.raw", 5).alias("raw"), F.round("c.normalized", 5).alias("normalized"),
    )


@query("split_hash", None)
def split_hash(spark, sf):
    return N.split_hash(split_stays(spark, sf))


# --- masks: the SQL repeats the draws, and masks are compared cell by cell -----------------------------

def U(seed, *parts):
    """SQL of ``stable_uniform``."""
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 15) AS BIGINT)::DOUBLE / {2**60}::DOUBLE)"


_CELL = ("stay_id", "hour", "feature_name")


def touched(df, *cols):
    """The cells that a mask may or did hide."""
    return df.filter("observed OR NOT visible").select(*_CELL, *cols)


@query("random_cell_mask", W(_C, f"SELECT stay_id, hour, feature_name, {U(0, "'random'", *_CELL)} >= 0.3 AS visible FROM cell WHERE observed"))
def random_cell_mask(spark, sf):
    return touched(K.cell_mask(cells(spark, sf), "random", 0.3), "visible")


@query("group_cell_masks", W(_C, f"""
SELECT stay_id, hour, feature_name, 'timestep' AS kind, {U(0, "'timestep'", "stay_id", "hour")} >= 0.3 AS visible FROM cell WHERE observed
UNION ALL SELECT stay_id, hour, feature_name, 'feature', {U(0, "'feature'", "stay_id", "feature_name")} >= 0.3 FROM cell WHERE observed"""))
def group_cell_masks(spark, sf):
    c = cells(spark, sf)
    by_hour, by_feature = (touched(K.cell_mask(c, kind, 0.3), F.lit(kind).alias("kind"), "visible") for kind in ("timestep", "feature"))
    return by_hour.unionByName(by_feature)


@query("masked_fill", W(_C, f"""
SELECT stay_id, hour, feature_name, round(CASE WHEN {U(0, "'random'", *_CELL)} >= 0.5 THEN value ELSE -1.0 END, 4) AS value FROM cell WHERE observed"""))
def masked_fill(spark, sf):
    m = K.fill_masked(K.cell_mask(cells(spark, sf), "random", 0.5), -1.0)
    return touched(m, F.round("value", 4).alias("value"))


@query("per_stay_ratio_mask", W(_C, f"SELECT stay_id, hour, feature_name, {U(0, *_CELL)} >= (stay_id % 5) / 4.0 AS visible FROM cell WHERE observed"))
def per_stay_ratio_mask(spark, sf):
    """Ratios from 0 to 1 in quarters: nothing, parts or everything of a stay is hidden."""
    c = cells(spark, sf).withColumn("ratio", (F.col("stay_id") % 5) / 4.0)
    return touched(K.per_stay_ratio_mask(c, "ratio"), "visible")


_BUDGET = "CASE WHEN n <= 1 THEN 0 ELSE least(greatest(CAST(floor(n * 0.4 + 0.5) AS INTEGER), 1), n - 1) END"
CTES["nvalid"] = f"SELECT stay_id, CAST(count(*) FILTER ({_ANY}) AS INTEGER) AS n FROM grid GROUP BY stay_id"


CTES["ranked"] = f"""
SELECT stay_id, hour, n, {_BUDGET} AS b, row_number() OVER (PARTITION BY stay_id ORDER BY {U(5, "stay_id", "hour")}, hour) AS rk
FROM grid JOIN nvalid USING (stay_id) WHERE {_ANY}"""


def hours(df, **flags):
    """One row per stay and hour with the named array columns."""
    zipped = F.arrays_zip(*[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in flags.items()])
    out = df.select("stay_id", F.posexplode(zipped).alias("hour", "_h"))
    return out.select("stay_id", "hour", *[F.col("_h")[k].alias(k) for k in flags])


@query("timestep_budget_mask", W(_G + " nvalid ranked", "SELECT stay_id, hour, rk > b AS visible FROM ranked"))
def timestep_budget_mask(spark, sf):
    m = K.timestep_mask(dense(spark, sf), 0.4, seed=5)
    return hours(m, visible="visible", valid=WI.seen_hours()).filter("valid OR NOT visible").drop("valid")


@query("block_timestep_mask", W(_G + " nvalid", f"""
SELECT stay_id, b AS n_hidden, CASE WHEN b = 0 THEN 0 ELSE least(3, b, n - b + 1) END AS n_blocks FROM (SELECT *, {_BUDGET} AS b FROM nvalid)"""))
def block_timestep_mask(spark, sf):
    """Hidden valid hours and their number of runs among the valid hours."""
    m = K.block_timestep_mask(dense(spark, sf), 0.4, n_blocks=3, seed=5)
    valid = F.filter(
        F.arrays_zip(F.col("visible").alias("v"), WI.seen_hours().alias("ok")), lambda c: c["ok"]
    )
    m = m.withColumn("_v", F.transform(valid, lambda c: c["v"]))
    runs = F.size(F.filter(
        F.transform("_v", lambda v, i: ~v & ((i == 0) | F.get("_v", i - 1))), lambda s: s))
    return m.select("stay_id", F.size(F.filter("_v", lambda v: ~v)).alias("n_hidden"), runs.alias("n_blocks"))


@query("contiguous_block_mask", W("ev stays", "SELECT count(*) AS n_stays, 0::BIGINT AS n_over_budget, 0::BIGINT AS n_under_budget FROM stays"))
def contiguous_block_mask(spark, sf):
    """Half of 48 hours: at most 24 hidden, and never 3 or more short of it while blocks are apart."""
    m = K.contiguous_block_mask(dense(spark, sf), 0.25, seed=3)
    hidden = F.size(F.filter("visible", lambda v: ~v))
    return m.agg(
        F.count(F.lit(1)).alias("n_stays"), F.count_if(hidden > 12).alias("n_over_budget"),
        F.count_if(hidden < 12 - 2).alias("n_under_budget"),
    )


@query("complementary_views", W(_G + " nvalid ranked", "SELECT stay_id, hour, n = 1 OR rk > b AS view_1, n = 1 OR rk <= b AS view_2 FROM ranked"))
def complementary_views(spark, sf):
    v = K.complementary_views(K.timestep_mask(dense(spark, sf), 0.4, seed=5))
    return hours(v, view_1="visible", view_2="visible_2", valid=WI.seen_hours()).filter("valid").drop("valid")


@query("view_counts", W(_G + " nvalid", f"""
SELECT round(avg(n - b), 6) AS n_visible_view1, round(avg(CASE WHEN n = 1 THEN 1 ELSE b END), 6) AS n_visible_view2,
  round(avg(b), 6) AS n_masked_view1, round(avg(CASE WHEN n = 1 THEN 0 ELSE n - b END), 6) AS n_masked_view2
FROM (SELECT *, {_BUDGET} AS b FROM nvalid)"""))
def view_counts(spark, sf):
    v = K.complementary_views(K.timestep_mask(dense(spark, sf), 0.4, seed=5))
    out = K.view_counts(v)
    return r6(out, *out.columns)


@query("token_mask", W(_C, f"""
SELECT stay_id, i, drawn OR (i = 0 AND NOT bool_or(drawn) OVER (PARTITION BY stay_id)) AS visible FROM (
 SELECT stay_id, i, {U(1, "stay_id", "i")} >= 0.9 AS drawn FROM (
  SELECT stay_id, CAST(row_number() OVER (PARTITION BY stay_id ORDER BY hour, d) - 1 AS INTEGER) AS i FROM cell WHERE observed))"""))
def token_mask(spark, sf):
    m = K.token_mask(WI.observed_tokens(dense(spark, sf)), 0.9, seed=1)
    return m.select("stay_id", F.posexplode("visible").alias("i", "visible"))


@query("visible_round_trip", W(_G + " nvalid", f"SELECT stay_id, n - {_BUDGET} AS n_steps, 0 AS n_changed FROM nvalid"))
def visible_round_trip(spark, sf):
    """Visible hours out and back on the grid; hours that differ from the source are counted."""
    m = K.timestep_mask(dense(spark, sf), 0.4, seed=5).withColumn("source", F.col("timeseries"))
    back = K.scatter_steps(K.visible_steps(m), T, len(FE), fill=-1.0)
    z = F.arrays_zip(
        F.col("source").alias("s"), F.col("timeseries").alias("t"), F.col("visible").alias("v"),
        WI.seen_hours().alias("ok"),
    )
    blank = F.array(*[F.lit(-1.0) for _ in FE])
    want = F.filter(z, lambda c: ~c["t"].eqNullSafe(F.when(c["v"] & c["ok"], c["s"]).otherwise(blank)))
    return back.select("stay_id", F.size("steps").alias("n_steps"), F.size(want).alias("n_changed"))


@query("shared_crop", W(_C, f"""
SELECT stay_id, crop_start, 24 AS crop_length, CAST(count(*) FILTER (observed AND hour >= crop_start AND hour < crop_start + 24) AS INTEGER) AS n_observed
FROM cell, (SELECT CAST(floor({U(9, "'crop'")} * 25) AS INTEGER) AS crop_start) GROUP BY ALL"""))
def shared_crop(spark, sf):
    c = K.shared_crop(dense(spark, sf), 0.5, T, seed=9)
    seen = F.size(F.filter(F.flatten("mask"), lambda m: m))
    return c.select("stay_id", "crop_start", F.size("timeseries").alias("crop_length"), seen.alias("n_observed"))


def _normal(seed):
    u1, u2 = (U(seed, *_CELL, f"'{part}'") for part in "ra")
    return f"sqrt(-2.0 * ln(greatest({u1}, {2.0 ** -60!r}::DOUBLE))) * cos(2.0 * pi() * {u2})"


@query("noisy_views", W(_C, f"""
SELECT stay_id, hour, feature_name, round(value + 0.1 * {_normal(4)}, 4) AS view_1, round(value + 0.1 * {_normal(5)}, 4) AS view_2 FROM cell WHERE observed"""))
def noisy_views(spark, sf):
    v = K.two_views(cells(spark, sf), 0.1, seed=4)
    changed = v.filter("observed OR view_1 IS NOT NULL OR view_2 IS NOT NULL")
    return changed.select(*_CELL, F.round("view_1", 4).alias("view_1"), F.round("view_2", 4).alias("view_2"))


_HELD = int(T * 0.3)


@query("holdout_masks", W(_C, f"""
, drawn AS (
 SELECT *, {U(2, *_CELL)} < 0.3 AS r, floor({U(2, "stay_id")} * {T - _HELD + 1}) AS t0,
  row_number() OVER (PARTITION BY stay_id, hour ORDER BY {U(2, "stay_id", "feature_name")}, feature_name) <= {max(1, int(len(FE) * 0.3))} AS f
 FROM cell),
held AS (SELECT 'random' AS kind, r AS held_out, * FROM drawn UNION ALL SELECT 'feature_block', f, * FROM drawn
 UNION ALL SELECT 'temporal_block', hour >= t0 AND hour < t0 + {_HELD}, * FROM drawn)
SELECT kind, stay_id, hour, feature_name, held_out, round(CASE WHEN held_out THEN 0.0 ELSE value END, 4) AS input FROM held WHERE observed""".strip()))
def holdout_masks(spark, sf):
    c, out = cells(spark, sf), None
    for kind in ("random", "feature_block", "temporal_block"):
        h = K.holdout(c, kind, 0.3, len(FE), T, seed=2).filter("observed OR held_out")
        one = h.select(F.lit(kind).alias("kind"), *_CELL, "held_out", F.round("input", 4).alias("input"))
        out = one if out is None else out.unionByName(one)
    return out


# --- imputation scores: every third hour is held out, filled with the feature's overall mean -------------

CTES["imp"] = """
SELECT c.*, m, sd FROM cell c JOIN (SELECT feature_name, avg(value) AS m,
  CASE WHEN count(value) <= 1 THEN 1.0 ELSE stddev_samp(value) END AS sd FROM cell GROUP BY 1) USING (feature_name)"""


def _imputed(spark, sf):
    c = cells(spark, sf)
    mean = c.groupBy("feature_name").agg(F.avg("value").alias("filled"))
    held = F.col("observed") & (F.col("hour") % 3 == 0)
    return c.join(F.broadcast(mean), "feature_name").withColumn("held_out", held)  # one row per feature


@query("observed_stds", W(_C, """
SELECT feature_name, count(value) AS n_obs, round(CASE WHEN count(value) <= 1 THEN 1.0 ELSE stddev_samp(value) END, 6) AS std
FROM cell GROUP BY 1 HAVING count(value) > 0"""))
def observed_stds(spark, sf):
    return r6(ME.observed_stds(cells(spark, sf)), "std")


@query("imputation_errors", W(_C + " imp", """
SELECT feature_name, count(*) AS n, round(sqrt(avg((m - value) ** 2)) / greatest(any_value(sd), 1e-8), 6) AS nrmse,
  round(avg(abs(m - value)), 6) AS mae FROM imp WHERE observed AND hour % 3 = 0 GROUP BY 1"""))
def imputation_errors(spark, sf):
    c = _imputed(spark, sf)
    return r6(ME.imputation_errors(c, ME.observed_stds(c)).drop("abs_error"), "nrmse", "mae")


@query("imputation_summary", W(_C + " imp", """
SELECT round(avg(e), 6) AS nrmse_overall, round(sum(a) / sum(n), 6) AS mae_overall, CAST(sum(n) AS BIGINT) AS n_cells FROM (
SELECT sqrt(avg((m - value) ** 2)) / greatest(any_value(sd), 1e-8) AS e, sum(abs(m - value)) AS a, count(*) AS n FROM imp WHERE observed AND hour % 3 = 0 GROUP BY feature_name)"""))
def imputation_summary(spark, sf):
    c = _imputed(spark, sf)
    return r6(ME.imputation_summary(ME.imputation_errors(c, ME.observed_stds(c))), "nrmse_overall", "mae_overall")


# --- missingness -----------------------------------------------------------------------------------------------

_D = len(FE)


@query("missing_overall", W(_G, f"""
SELECT count(*) * {_D} AS total_cells, CAST(sum({_SEEN}) AS BIGINT) AS total_observed,
  CAST(count(*) * {_D} - sum({_SEEN}) AS BIGINT) AS total_missing, round(100.0 * (1 - sum({_SEEN}) / (count(*) * {_D})), 6) AS missing_pct FROM grid"""))
def missing_overall(spark, sf):
    return r6(D.overall(grid(spark, sf), FE), "missing_pct")


def _per_feature_sql(where):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER ({f}_mask) AS observed_count, count(*) AS total_count, "
        f"100.0 * (1 - count(*) FILTER ({f}_mask) / count(*)) AS missing_pct FROM {where}" for f in FE
    )


CTES["mfeat"] = _per_feature_sql("grid")


@query("missing_per_feature", W(_G + " mfeat", "SELECT feature, observed_count, total_count, round(missing_pct, 6) AS missing_pct FROM mfeat"))
def missing_per_feature(spark, sf):
    return r6(D.per_feature(grid(spark, sf), FE), "missing_pct")


@query("missing_extremes", W(_G + " mfeat", """
(SELECT feature, 'top' AS "end" FROM mfeat ORDER BY missing_pct DESC, feature LIMIT 2) UNION ALL
(SELECT feature, 'bottom' AS "end" FROM mfeat ORDER BY missing_pct, feature LIMIT 2)"""))
def missing_extremes(spark, sf):
    return D.extremes(D.per_feature(grid(spark, sf), FE), 2).select("feature", "end")


CTES["mstay"] = f"""
SELECT stay_id, count(*) * {_D} AS n_total, CAST(sum({_SEEN}) AS BIGINT) AS n_observed,
  100.0 * (1 - sum({_SEEN}) / (count(*) * {_D})) AS pct FROM grid GROUP BY stay_id"""


@query("missing_per_stay", W(_G + " mstay", "SELECT stay_id, n_total, n_observed, round(pct, 6) AS missingness_pct FROM mstay"))
def missing_per_stay(spark, sf):
    return r6(D.per_stay(dense(spark, sf)), "missingness_pct")


def _per_stay(spark, sf):
    return D.per_stay_rows(grid(spark, sf), FE)


@query("missing_by_group", W(_G + " mstay", """
SELECT segment, count(*) AS n_patients, round(avg(pct), 6) AS mean_missing_pct, round(stddev_samp(pct), 6) AS std_missing_pct,
  round(min(pct), 6) AS min_missing_pct, round(max(pct), 6) AS max_missing_pct, round(median(pct), 6) AS median_missing_pct
FROM mstay JOIN stays USING (stay_id) GROUP BY segment"""))
def missing_by_group(spark, sf):
    out = D.by_group(_per_stay(spark, sf), A.stays(spark, sf), "segment")
    return r6(out, *[c for c in out.columns if c.endswith("_pct")])


@query("missing_per_hour", W(_G, f"""
SELECT hour, CAST(sum({_SEEN}) AS BIGINT) AS observed_count, count(*) * {_D} AS total_count,
  round(100.0 * (1 - sum({_SEEN}) / (count(*) * {_D})), 6) AS missing_pct FROM grid GROUP BY hour"""))
def missing_per_hour(spark, sf):
    return r6(D.per_hour(grid(spark, sf), FE), "missing_pct")


CTES["pres"] = f"""
SELECT g.*, CAST(least(ceil(los_days * 24), {T}) AS INTEGER) AS los_hours, hour < least(ceil(los_days * 24), {T}) AS present
FROM grid g JOIN stays USING (stay_id)"""
_P = _G + " pres"


def presence(spark, sf):
    return D.with_presence(grid(spark, sf), A.stays(spark, sf), T)


@query("missing_true_structural", W(_P, f"""
SELECT count(*) * {_D} AS total_cells, CAST(sum({_SEEN}) FILTER (present) AS BIGINT) AS total_observed,
  CAST(count(*) FILTER (present) * {_D} - sum({_SEEN}) FILTER (present) AS BIGINT) AS total_true_missing,
  count(*) FILTER (NOT present) * {_D} AS total_structural_missing,
  round(100.0 * (count(*) FILTER (present) * {_D} - sum({_SEEN}) FILTER (present)) / (count(*) FILTER (present) * {_D}), 6) AS true_missing_pct,
  round(100.0 * count(*) FILTER (NOT present) / count(*), 6) AS structural_pct FROM pres"""))
def missing_true_structural(spark, sf):
    return r6(D.true_and_structural(presence(spark, sf), FE), "true_missing_pct", "structural_pct")


@query("missing_per_stay_true", W(_P, f"""
SELECT stay_id, max(los_hours) AS los_hours, count(*) FILTER (present) * {_D} AS true_window_cells,
  CAST(coalesce(sum({_SEEN}) FILTER (present), 0) AS BIGINT) AS true_window_observed,
  round(CASE WHEN count(*) FILTER (present) = 0 THEN 100.0 ELSE 100.0 * (count(*) FILTER (present) * {_D} - sum({_SEEN}) FILTER (present)) / (count(*) FILTER (present) * {_D}) END, 6) AS true_missing_pct,
  count(*) FILTER (NOT present) * {_D} AS structural_cells FROM pres GROUP BY stay_id"""))
def missing_per_stay_true(spark, sf):
    return r6(D.per_stay_true(presence(spark, sf), FE), "true_missing_pct")


@query("missing_per_hour_true", W(_P, f"""
SELECT hour, CAST(coalesce(sum({_SEEN}) FILTER (present), 0) AS BIGINT) AS observed_count, count(*) FILTER (present) AS patients_present,
  count(*) FILTER (present) * {_D} AS total_count,
  round(100.0 * (1 - sum({_SEEN}) FILTER (present) / (count(*) FILTER (present) * {_D})), 6) AS missing_pct FROM pres GROUP BY hour"""))
def missing_per_hour_true(spark, sf):
    return r6(D.per_hour_true(presence(spark, sf), FE), "missing_pct")


@query("missing_per_feature_true", W(_P, "SELECT feature, observed_count, total_count, round(missing_pct, 6) AS missing_pct FROM ("
                                     + _per_feature_sql("pres WHERE present") + ")"))
def missing_per_feature_true(spark, sf):
    return r6(D.per_feature(presence(spark, sf), FE, F.col("present")), "missing_pct")


@query("missing_distribution", W(_G + " mstay", """
SELECT round(avg(pct), 6) AS mean, round(stddev_samp(pct), 6) AS std, round(min(pct), 6) AS min, round(max(pct), 6) AS max,
  round(quantile_cont(pct, 0.25), 6) AS q25, round(median(pct), 6) AS median, round(quantile_cont(pct, 0.75), 6) AS q75 FROM mstay"""))
def missing_distribution(spark, sf):
    out = D.distribution(_per_stay(spark, sf))
    return r6(out, *out.columns)


@query("missing_histogram", W(_G + " mstay", """
SELECT CASE WHEN pct < 50 THEN '0-50' WHEN pct < 60 THEN '50-60' WHEN pct < 70 THEN '60-70' WHEN pct < 80 THEN '70-80'
  WHEN pct < 90 THEN '80-90' WHEN pct < 95 THEN '90-95' ELSE '95-100' END AS bucket, count(*) AS n_patients FROM mstay WHERE pct < 100 GROUP BY 1"""))
def missing_histogram(spark, sf):
    return D.histogram(_per_stay(spark, sf))


@query("missing_dense_against_true", W(_P, f"""
SELECT hour, round(dense, 6) AS dense_pct, round(tru, 6) AS true_pct, round(dense - tru, 6) AS difference FROM (
SELECT hour, 100.0 * (1 - sum({_SEEN}) / (count(*) * {_D})) AS dense,
  100.0 * (1 - sum({_SEEN}) FILTER (present) / (count(*) FILTER (present) * {_D})) AS tru FROM pres GROUP BY hour)"""))
def missing_dense_against_true(spark, sf):
    p = presence(spark, sf)
    out = D.dense_against_true(D.per_hour(p, FE), D.per_hour_true(p, FE))
    return r6(out, "dense_pct", "true_pct", "difference")


@query("missingness_sample", W(_G + " mstay", """
SELECT stay_id, missingness_bin FROM (SELECT stay_id, CASE WHEN pct <= 10 THEN '<10%' WHEN pct <= 30 THEN '10-30%' WHEN pct <= 50 THEN '30-50%'
  WHEN pct <= 70 THEN '50-70%' ELSE '>70%' END AS missingness_bin FROM mstay)
QUALIFY row_number() OVER (PARTITION BY missingness_bin ORDER BY CAST('0x' || substr(md5('42|' || CAST(stay_id AS VARCHAR)), 1, 15) AS BIGINT), stay_id) <= 3"""))
def missingness_sample(spark, sf):
    return CO.missingness_sample(D.per_stay(dense(spark, sf))).select("stay_id", "missingness_bin")


# --- stage inspection ---------------------------------------------------------------------------------------------

@query("stage_summary", W(_C, """
SELECT feature_name, count(*) AS n_rows, min(hour) AS first_hour, max(hour) AS last_hour, round(min(value), 6) AS min_value,
  round(max(value), 6) AS max_value, count(*) FILTER (observed) AS n_observed, count(*) FILTER (NOT observed) AS n_missing FROM cell GROUP BY 1"""))
def stage_summary(spark, sf):
    from cohortspark.operators.stages import stage_summary as summarize

    return r6(summarize(cells(spark, sf), ["feature_name"]), "min_value", "max_value")


@query("stage_difference", W("ev cleaned", """
SELECT event_id, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS value_diff,
  round((b.value - a.value) / abs(a.value) * 100, 6) AS pct_change
FROM (SELECT event_id, value FROM ev) a FULL JOIN (SELECT event_id, value * 1.5 AS value FROM cleaned WHERE feature <> 'view') b USING (event_id)"""))
def stage_difference(spark, sf):
    from cohortspark.operators.stages import stage_difference as diff

    a = A.raw_events(spark, sf).select("event_id", "value")
    b = A.events(spark, sf).filter("feature <> 'view'").select("event_id", (F.col("value") * 1.5).alias("value"))
    return r6(diff(a, b, ["event_id"], "value"), "value_diff", "pct_change")
