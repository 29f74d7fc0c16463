"""Bootstrap intervals, paired tests, effect sizes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.hashing import cell_uniform, poisson_one
from cohortspark.operators.ordering import (
    null_safe_join,
    running_totals,
    value_cuts,
    with_bucket,
)
from cohortspark.operators.resampling import PRIME, WeightedSums, cell_key, metric_states, replicates, weights
from cohortspark.session import broadcast_if_small, cut_lineage

NAN = float("nan")
EXACT_PAIRS = 50
FEW_FAMILIES = 100_000


# --- intervals -----------------------------------------------------------------------------

def interval(
    replicates: DataFrame, names: Sequence[str], by: Sequence[str] = (), level: float = 0.95
) -> DataFrame:
    """(metric, ci_lower, ci_upper, std, n_valid) over finite replicate values.

    The frame holds one row per replicate and group, so its quantiles are small work.
    """
    a = (1.0 - level) / 2.0
    cells = F.explode(
        F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("v")) for x in names])
    )
    long = replicates.select(*by, cells.alias("_c")).select(*by, "_c.*")
    ok = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return ok.groupBy(*by, "metric").agg(
        F.percentile("v", F.lit(a)).alias("ci_lower"),
        F.percentile("v", F.lit(1.0 - a)).alias("ci_upper"),
        F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("n_valid"),
    )


def bootstrap_ci(
    df: DataFrame, metric: str | WeightedSums | Callable[[DataFrame], DataFrame], n: int = 1000, seed: int = 42,
    level: float = 0.95, ids: Sequence[str] = ("stay_id",),
) -> DataFrame:
    """Point estimate and percentile interval of one metric.

    ``metric`` is ``auroc``, ``auprc``, a name of ``metric_states``, a metric of one's own as ``WeightedSums``, or,
    for what is no function of sums, a function that maps a frame with columns ``replicate, weight,
    prediction, label`` to ``(replicate, value)``; only the last copies rows per replicate.
    """
    if metric in ("auroc", "auprc"):
        from cohortspark.operators.metrics import ranking_metrics

        point = ranking_metrics(df).select(F.col(metric).alias("point"))
        reps = replicate_ranking(df, n, seed, draws=cell_key(seed, ["_y"], ["prediction"]))
        return point.crossJoin(interval(reps, [metric], (), level))  # two one-row frames
    if not isinstance(metric, (str, WeightedSums)):
        whole = df.withColumns({"replicate": F.lit(0), "weight": F.lit(1)})
        point = metric(whole).select(F.col("value").alias("point"))
        rep = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
        rep = rep.withColumn("weight", poisson_one(cell_uniform(seed, "replicate", *ids)))
        return point.crossJoin(interval(metric(rep.filter("weight > 0")), ["value"], (), level))  # two one-row frames
    name = metric if isinstance(metric, str) else "value"
    return bootstrap_intervals(df, {name: metric_states()[metric] if isinstance(metric, str) else metric}, n, seed, (), level).select(
        "point", "metric", "ci_lower", "ci_upper", "std", "n_valid"
    )


def bootstrap_intervals(
    df: DataFrame, metrics: dict[str, WeightedSums], n: int = 1000, seed: int = 42, by: Sequence[str] = (), level: float = 0.95,
) -> DataFrame:
    """(by, metric, point, ci_lower, ci_upper, std, n_valid) of several metrics and groups from one pass over the rows."""
    by = list(by)
    reps = cut_lineage(replicates(df, metrics, n, seed, by))  # read for the points and for the intervals
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("point")) for x in metrics]))
    points = reps.filter("replicate = 0").select(*by, cells.alias("_c")).select(*by, "_c.*")
    spread = interval(reps.filter("replicate > 0"), list(metrics), by, level)
    joined = null_safe_join(points, spread, [*by, "metric"], "left")  # a row per group and metric on either side
    return joined.withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


# --- bootstrap of ranking metrics ----------------------------------------------------------

def replicate_ranking(
    df: DataFrame, n: int, seed: int, score: str = "prediction", label: str = "label",
    key: Sequence[str] | None = None, draws: Column | None = None,
) -> DataFrame:
    """(replicate, auroc, auprc) under Poisson resampling weights, single-class ones null.

    Rows of equal label and ``key`` (the score, or several scores that share the draws)
    collapse to cells; ``draws`` of their label ``_y`` and key fixes their weights. Cells go to score buckets, one bucket to one task, sorted by score.
    A first pass adds up each bucket's class weights; their running totals become the
    bucket's offsets, which a second pass reads ahead of the bucket's cells. Both passes
    stream: a task holds one Arrow batch and a few numbers per replicate.
    """
    key = list(key or [score])
    y = (F.col(label) == 1).cast("int").alias("_y")
    cells = df.groupBy(y, *key).agg(F.count(F.lit(1)).alias("_c"))
    cells = cut_lineage(  # the cut points and both passes read it
        cells.select(
            "_y", "_c", (-F.col(score).cast("double")).alias("_s"),
            (F.xxhash64(F.lit(int(seed)), "_y", *key) if draws is None else draws).alias("_h"),
        )
    )
    cut = with_bucket(cells, "_s", value_cuts(cells, "_s"))

    def totals(batches):
        bucket, pos, neg = None, np.zeros(n), np.zeros(n)
        for pdf in batches:
            for now, part in pdf.groupby("_bucket", sort=True):
                if bucket is not None and now != bucket:
                    yield pd.DataFrame({"_bucket": [bucket], "pos": [pos], "neg": [neg]})
                    pos, neg = np.zeros(n), np.zeros(n)
                bucket = now
                for rows, w in _weighted_chunks(part, n):
                    hit = rows["_y"].to_numpy() == 1
                    pos = pos + w[hit].sum(0)
                    neg = neg + w[~hit].sum(0)
        if bucket is not None:
            yield pd.DataFrame({"_bucket": [bucket], "pos": [pos], "neg": [neg]})

    by_bucket = cut.repartition("_bucket").sortWithinPartitions("_bucket")
    per = by_bucket.mapInPandas(totals, "_bucket int, pos array<double>, neg array<double>")
    flat = per.select("_bucket", F.posexplode(F.arrays_zip("pos", "neg")).alias("i", "c"))
    above = Window.partitionBy("i").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = flat.select(
        "_bucket", "i",
        F.coalesce(F.sum("c.pos").over(above), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum("c.neg").over(above), F.lit(0.0)).alias("q"),
    )
    offsets = ahead.groupBy("_bucket").agg(  # n numbers per bucket
        F.sort_array(F.collect_list(F.struct("i", "p", "q"))).alias("o")
    ).select(
        "_bucket", F.lit(0).alias("_kind"),
        # no nulls among the whole numbers: pandas would turn the column into doubles
        F.lit(0).alias("_y"), F.lit(0).cast("bigint").alias("_c"), F.lit(0.0).alias("_s"),
        F.lit(0).cast("bigint").alias("_h"),
        F.transform("o", lambda x: x["p"]).alias("pos0"), F.transform("o", lambda x: x["q"]).alias("neg0"),
    )
    stream = cut.withColumn("_kind", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    ordered = stream.repartition("_bucket").sortWithinPartitions("_bucket", "_kind", "_s")

    def terms(batches):
        walk = _RankWalk(n)
        for pdf in batches:
            marks = np.flatnonzero(pdf["_kind"].to_numpy() == 0)
            edges = [0, *[m for m in marks if m > 0], len(pdf)]
            for lo, hi in zip(edges, edges[1:]):
                part = pdf.iloc[lo:hi]
                if part["_kind"].iloc[0] == 0:
                    walk.start(part["pos0"].iloc[0], part["neg0"].iloc[0])
                    part = part.iloc[1:]
                for rows, w in _weighted_chunks(part, n):
                    walk.add(rows["_s"].to_numpy(), rows["_y"].to_numpy(), w)
        walk.settle_open()
        yield pd.DataFrame({k: [v] for k, v in walk.sums.items()})

    kinds = ", ".join(f"{k} array<double>" for k in _RankWalk.NAMES)
    parts = ordered.mapInPandas(terms, kinds)
    rows = parts.select(F.posexplode(F.arrays_zip(*_RankWalk.NAMES)).alias("i", "c"))
    total = rows.groupBy("i").agg(*[F.sum(f"c.{k}").alias(k) for k in _RankWalk.NAMES])
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return total.select(
        (F.col("i") + 1).cast("int").alias("replicate"),
        F.when(both, 1.0 - F.col("wrong") / (F.col("pos") * F.col("neg"))).alias("auroc"),
        F.when(both, F.col("gain") / F.col("pos")).alias("auprc"),
    )


class _RankWalk:
    """Walks cells by falling score and adds up the terms of both ranking metrics."""

    NAMES = ("pos", "neg", "wrong", "gain")

    def __init__(self, n: int):
        self.sums = {k: np.zeros(n) for k in self.NAMES}
        self.tp = self.fp = np.zeros(n)
        self.open = None  # the tie block that may go on in the next chunk

    def start(self, pos0, neg0) -> None:
        self.settle_open()
        self.tp, self.fp = np.asarray(pos0, dtype="float64"), np.asarray(neg0, dtype="float64")

    def add(self, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        values, first = np.unique(s, return_index=True)  # rows come sorted by s
        hit = (y == 1)[:, None]
        pos = np.add.reduceat(w * hit, first, axis=0).astype("float64")
        neg = np.add.reduceat(w * ~hit, first, axis=0).astype("float64")
        if self.open is not None:
            if self.open[0] == values[0]:
                pos[0] += self.open[1]
                neg[0] += self.open[2]
                self.open = None
            else:
                self.settle_open()
        self._settle(pos[:-1], neg[:-1])
        self.open = (values[-1], pos[-1], neg[-1])

    def settle_open(self) -> None:
        if self.open is not None:
            self._settle(self.open[1][None, :], self.open[2][None, :])
            self.open = None

    def _settle(self, pos: np.ndarray, neg: np.ndarray) -> None:
        if not len(pos):
            return
        tp, fp = self.tp + np.cumsum(pos, axis=0), self.fp + np.cumsum(neg, axis=0)
        seen = np.maximum(tp + fp, 1.0)
        self.sums["pos"] = self.sums["pos"] + pos.sum(0)
        self.sums["neg"] = self.sums["neg"] + neg.sum(0)
        self.sums["wrong"] = self.sums["wrong"] + (pos * (fp - neg / 2.0)).sum(0)
        self.sums["gain"] = self.sums["gain"] + (pos * tp / seen).sum(0)
        self.tp, self.fp = tp[-1], fp[-1]


def _weighted_chunks(part: pd.DataFrame, n: int, rows: int = 1024):
    """Short runs of rows with their (rows x n) weights."""
    for lo in range(0, len(part), rows):
        chunk = part.iloc[lo:lo + rows]
        h = chunk["_h"].to_numpy(dtype="int64").view(np.uint64)
        yield chunk, cell_weights(h, chunk["_c"].to_numpy(dtype="int64"), n)


def cell_weights(h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(cells x n) resampling weights of cells with row counts, fixed by the cell's hash."""
    return weights((h % np.uint64(PRIME)).astype(np.int64), np.asarray(count, np.int64), n)


# --- paired bootstrap ---------------------------------------------------------------------------

def paired_bootstrap(
    df: DataFrame, metric: str | WeightedSums, a: str, b: str, n: int = 1000, seed: int = 42,
    higher_is_better: bool = True,
) -> DataFrame:
    """One-sided shift test of two scores on the same replicate weights.

    ``metric`` is ``auroc``, ``auprc``, a name of ``metric_states``, or one's own ``WeightedSums``.
    """
    if metric in ("auroc", "auprc"):
        from cohortspark.operators.metrics import ranking_metrics

        whole = [ranking_metrics(df.withColumn("prediction", F.col(c))).select(F.col(metric).alias(f"score_{k}"))
                 for k, c in (("a", a), ("b", b))]
        point = whole[0].crossJoin(whole[1])  # one row each
        draws = cell_key(seed, ["_y"], [a, b])
        ra, rb = (
            replicate_ranking(df, n, seed, c, key=[a, b], draws=draws).select("replicate", F.col(metric).alias(k))
            for k, c in (("a", a), ("b", b))
        )
        reps = ra.join(rb, "replicate")
    else:
        state = metric_states()[metric] if isinstance(metric, str) else metric
        both = cut_lineage(replicates(df, {"value": state}, n, seed, (), {"_a": a, "_b": b}))  # n + 1 rows
        both = both.select("replicate", F.col("value_a").alias("a"), F.col("value_b").alias("b"))
        point = both.filter("replicate = 0").select(F.col("a").alias("score_a"), F.col("b").alias("score_b"))
        reps = both.filter("replicate > 0")
    delta = F.col("score_a") - F.col("score_b")
    boot = F.col("a") - F.col("b")
    extreme = boot >= 2 * delta if higher_is_better else boot <= 2 * delta
    # the point is one row; it stays when no replicate is valid
    joined = point.join(reps.filter(boot.isNotNull() & ~F.isnan(boot)), F.lit(True), "left")
    tested = joined.agg(
        F.first("score_a").alias("score_a"), F.first("score_b").alias("score_b"),
        F.first(delta).alias("delta"), F.coalesce(F.avg(extreme.cast("double")), F.lit(NAN)).alias("p_value"),
        F.count("replicate").alias("n_valid"),
    )
    return tested.withColumn("significant_at_005", F.coalesce(~F.isnan("p_value") & (F.col("p_value") < 0.05), F.lit(False)))


# --- signed-rank test -----------------------------------------------------------------------------

def signed_rank(pairs: DataFrame, by: Sequence[str], diff: str = "diff", correction: bool = True):
    """Two-sided signed-rank test per family of paired differences.

    Infinite and NaN differences are dropped, zeros do not count. Up to 50 non-zero
    pairs the tie-free null distribution is used exactly, half sums rounded away from
    significance; above that a normal approximation with tie correction. Ranks come
    from tie-collapsed running counts, so a family of any size stays distributed.
    """
    by = list(by)
    d = F.col(diff)
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    sizes = pairs.groupBy(*by).agg(
        F.count_if(finite).alias("n_pairs"), F.count_if(finite & (d != 0)).alias("n_nonzero_pairs")
    )
    ties = (
        pairs.filter(finite & (d != 0))
        .withColumn("_abs", F.abs(d).cast("double"))
        .groupBy(*by, "_abs")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("up"))
    )
    cum = running_totals(ties, by, "_abs", ["n"])
    # twice the average rank of a block of equal differences, a whole number
    twice = (2 * F.col("before_n") + F.col("n") + 1).cast("double")
    sums = cum.groupBy(*by).agg(
        (F.sum(F.col("up") * twice) / 2.0).alias("w_plus"),
        (F.sum((F.col("n") - F.col("up")) * twice) / 2.0).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"),
    )
    # without groups both sides are one row
    base = null_safe_join(sizes, sums, by, "left") if by else sizes.crossJoin(sums)
    n = F.col("n_nonzero_pairs").cast("double")
    mean = n * (n + 1) / 4.0
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    shift = F.lit(0.5 if correction else 0.0)
    off = F.col("w_plus") - mean
    base = base.withColumn("statistic", F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)))
    base = base.withColumn(
        "z_score",
        F.when((F.col("n_pairs") == 0) | (n == 0), 0.0)
        .when(n <= EXACT_PAIRS, NAN)
        .otherwise((off - F.signum(off) * shift) / sd),
    )
    p = (
        F.when(F.col("n_pairs") == 0, NAN)
        .when(n == 0, 1.0)
        .when(n <= EXACT_PAIRS, exact_two_sided(F.col("n_nonzero_pairs"), F.col("statistic")))
        .otherwise(2.0 * normal_tail(F.abs("z_score")))
    )
    return base.select(*by, "statistic", "z_score", p.alias("p_value"), "n_pairs", "n_nonzero_pairs")


def exact_two_sided(n: Column, statistic: Column) -> Column:
    """2 * P(W <= ceil(statistic)), W the sum of a random subset of 1..n.

    ``counts[s]`` is the number of subsets with sum ``s``; adding rank ``r`` shifts
    the counts by ``r`` and adds them. At most 50 ranks and 1276 sums.
    """
    size = F.least(n, F.lit(EXACT_PAIRS)).cast("int")
    total = size * (size + 1) / 2
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), total.cast("int")))

    def add_rank(counts, r):
        moved = F.concat(F.array_repeat(F.lit(0.0), r), counts)
        return F.zip_with(counts, F.slice(moved, F.lit(1), F.size(counts)), lambda x, y: x + y)

    counts = F.aggregate(F.sequence(F.lit(1), size), start, add_rank)
    low = F.slice(counts, F.lit(1), F.ceil(statistic).cast("int") + 1)
    below = F.aggregate(low, F.lit(0.0), lambda acc, x: acc + x)
    return F.least(2.0 * below / F.pow(F.lit(2.0), size), F.lit(1.0))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: power series near 0, continued fraction far out."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: k.cast("double"))
    x = z / F.lit(2.0**0.5)
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc, k):
        term = -acc["term"] * z * z / 2.0 / k
        return F.struct(term.alias("term"), (acc["total"] + term / (2 * k + 1)).alias("total"))

    near = 0.5 - F.aggregate(terms, start, add)["total"] / F.lit(3.141592653589793**0.5)
    frac = F.aggregate(F.reverse(terms), F.lit(0.0), lambda acc, k: k / (z + acc))
    far = F.exp(-z * z / 2.0) / F.lit(2.5066282746310002) / (z + frac)
    return F.when(z < 3.0, near).otherwise(far)


# --- correction and effect size ---------------------------------------------------------------------

def bonferroni(df: DataFrame, family: Sequence[str], p: str = "p_value") -> DataFrame:
    """Times the number of finite p-values in the family, at most 1; NaN stays NaN.

    The counts are one row per family; they are broadcast if they are few, and joined by a shuffle, which
    splits a hot family, if not. The input is read twice, so it is written out once.
    """
    df = cut_lineage(df)
    known = F.col(p).isNotNull() & ~F.isnan(p)
    n = df.groupBy(*family).agg(F.count_if(known).alias("_m"))
    joined = null_safe_join(df, broadcast_if_small(n, FEW_FAMILIES) if family else F.broadcast(n), list(family))
    fixed = F.when(known, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).otherwise(NAN)
    return joined.withColumn("p_value_bonferroni", fixed).withColumn(
        "significant_bonferroni_005", known & (F.col("p_value_bonferroni") < 0.05)
    ).drop("_m")


def _effect(mean: Column, std: Column, ok: Column) -> Column:
    signed_inf = F.when(mean > 0, float("inf")).otherwise(float("-inf"))
    return (
        F.when(~ok, NAN)
        .when((std == 0) & (mean == 0), 0.0)
        .when(std == 0, signed_inf)
        .otherwise(mean / std)
    )


def cohens_d(pairs: DataFrame, by: Sequence[str], a: str = "value_a", b: str = "value_b",
             paired: bool = True) -> DataFrame:
    """Effect size of finite pairs; infinite when the spread is 0 and the mean is not."""
    x, y = F.col(a), F.col(b)
    inf = F.lit(float("inf"))
    ok = pairs.filter(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < inf) & (F.abs(y) < inf))
    n = F.count(F.lit(1))
    if paired:
        mean, std = F.avg(x - y), F.stddev_samp(x - y)
    else:
        mean = F.avg(x) - F.avg(y)
        pooled = (F.var_samp(x) + F.var_samp(y)) * (n - 1) / F.greatest(2 * n - 2, F.lit(1))
        std = F.sqrt(F.greatest(pooled, F.lit(0.0)))
    return ok.groupBy(*by).agg(n.alias("n_pairs"), _effect(mean, std, n >= 2).alias("cohens_d"))


# --- positive rate ---------------------------------------------------------------------------------------

def positive_rate_ci(
    df: DataFrame, by: Sequence[str] = (), n: int = 1000, seed: int = 42, level: float = 0.95
) -> DataFrame:
    """Bootstrap interval of a positive rate from the two counts alone.

    Resampling n labels and averaging is a binomial draw; one task per group draws
    ``n`` of them, whatever the number of labels.
    """
    counts = df.filter(F.col("label").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("positive_rate")
    )
    keyed = counts.withColumn("_seed", F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in by]), F.lit(1 << 31)))
    a = (1.0 - level) / 2.0

    @F.pandas_udf("struct<low: double, high: double>")
    def draw(size: pd.Series, rate: pd.Series, key: pd.Series) -> pd.DataFrame:
        out = []
        for s, p, k in zip(size, rate, key):
            rates = np.random.default_rng(int(k)).binomial(int(s), float(p), n) / int(s)
            out.append(np.quantile(rates, [a, 1.0 - a]))
        return pd.DataFrame(out, columns=["low", "high"])

    drawn = keyed.withColumn("_ci", draw("n", "positive_rate", "_seed"))
    return drawn.select(
        *by, "n", "positive_rate", F.col("_ci.low").alias("ci_lower"), F.col("_ci.high").alias("ci_upper")
    )
