"""Diagnostics of vector tables ``(id, embedding array)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.values import let

DEAD_STD = 1e-6
#: a sample of this many pairs is a few megabytes of ids
BROADCAST_PAIRS = 200_000


def dim_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Per dimension: mean, population std, min, max."""
    cells = df.select(F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return cells.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )


def global_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Number of vectors, width, and moments over all numbers, folded inside each row."""
    x = F.transform(vec, lambda v: v.cast("double"))
    s = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    q = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    n = F.sum(F.size(vec))
    mean = F.sum(s) / n
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size(vec)).alias("embedding_dim"),
        mean.alias("global_mean"),
        F.sqrt(F.greatest(F.sum(q) / n - mean * mean, F.lit(0.0))).alias("global_std"),
    )


def gram(df: DataFrame, vec: str = "embedding", unit: bool = False) -> DataFrame:
    """(i, j, s): sums over all rows of x_i * x_j for i <= j; i = -1 stands for the constant one, so (-1, -1) counts the rows.

    With ``unit`` rows are scaled to length one first. Rows that are null or hold a null or non-finite number, or
    whose width is not that of most rows of their task's first batch, fail: a vector table has one width. A task
    hands on one number per pair of dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            column = batch.column("v").drop_null()
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) % len(column) or total is not None and len(x) // len(column) + 1 != len(total):
                raise ValueError("vectors differ in width")
            x = x.reshape(len(column), -1)
            if unit:
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            part = x.T @ x
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    rows = df.select(F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def gram_matrix(df: DataFrame, vec: str = "embedding", unit: bool = False) -> np.ndarray:
    """The sums of ``gram`` as one symmetric matrix on the driver; its size is set by the vector width."""
    rows = gram(df, vec, unit).collect()
    out = np.zeros((max((r["j"] for r in rows), default=-2) + 2,) * 2)
    for i, j, s in rows:
        out[i + 1, j + 1] = out[j + 1, i + 1] = s
    return out


def covariance(df: DataFrame, vec: str = "embedding") -> tuple[int, np.ndarray]:
    """Row count and D x D sample covariance, from one pass over the rows."""
    g = gram_matrix(df, vec)
    if not len(g):
        return 0, np.zeros((0, 0))
    n = round(g[0, 0])
    if n == 1:
        return 1, np.zeros((len(g) - 1,) * 2)
    return n, (g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n) / (n - 1)


def participation(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Total variance, squared norm of the covariance and participation ratio, from the Gram sums alone."""
    g = gram(df, vec)
    ends = g.filter("i = -1 AND j >= 0").select("j", F.col("s").alias("m"))  # a row per dimension
    n = g.filter("j = -1").select(F.col("s").alias("n"))  # one row
    centred = g.filter("i >= 0").join(F.broadcast(ends.toDF("i", "mi")), "i").join(F.broadcast(ends.toDF("j", "mj")), "j").crossJoin(F.broadcast(n))
    c = F.when(F.col("n") > 1, (F.col("s") - F.col("mi") * F.col("mj") / F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    both = centred.select("i", "j", "n", c.alias("c"))
    out = both.agg(
        F.max("n").cast("bigint").alias("n_samples"), F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)).alias("total_variance"),
        F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("c") * F.col("c")).alias("squared_norm"),
    )
    t, q = F.col("total_variance"), F.col("squared_norm")
    return out.withColumn("participation_ratio", F.when(q == 0, 0.0).otherwise(t * t / q))


def cosine_moments(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Exact mean and population std of the cosines of all pairs of different rows, without making a pair.

    With unit rows u, the cosines of all ordered pairs add up to |sum u|^2, and their squares to the squared norm
    of the Gram matrix; each row's pair with itself is taken off.
    """
    g = gram(df, vec, unit=True)
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    own = F.col("i") >= 0
    sums = g.agg(
        F.coalesce(F.max(F.when(F.col("j") == -1, F.col("s"))), F.lit(0.0)).alias("n"),
        F.sum(F.when((F.col("i") == -1) & (F.col("j") >= 0), F.col("s") * F.col("s")).otherwise(0.0)).alias("a"),
        F.sum(F.when(own, twice * F.col("s") * F.col("s")).otherwise(0.0)).alias("b"),
        F.sum(F.when(own & (F.col("i") == F.col("j")), F.col("s")).otherwise(0.0)).alias("d"),
    )
    # |u| is 1 but for zero rows, whose cosine with themselves is 0 and has no part in either sum
    pairs = F.col("n") * (F.col("n") - 1)
    mean, square = (F.col("a") - F.col("d")) / pairs, (F.col("b") - F.col("d")) / pairs
    some = F.col("n") > 1
    return sums.select(
        F.when(some, mean).otherwise(0.0).alias("mean_cosine"),
        F.when(some, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).otherwise(0.0).alias("std_cosine"),
        F.coalesce(pairs / 2, F.lit(0.0)).cast("bigint").alias("n_pairs"),
    )


def eigenvalues(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """(component, eigenvalue, explained, cumulative), largest first."""
    n, cov = covariance(df, vec)
    k = min(n, cov.shape[0])
    values = np.clip(np.linalg.eigvalsh(cov)[::-1][:k], 0.0, None) if k else np.zeros(0)
    total = float(np.trace(cov)) or 1.0
    share = values / total
    rows = [
        (i, float(values[i]), float(share[i]), float(share[: i + 1].sum())) for i in range(k)
    ]
    schema = "component int, eigenvalue double, explained double, cumulative double"
    return df.sparkSession.createDataFrame(rows, schema)


def dimensionality(spectrum: DataFrame) -> DataFrame:
    """Effective rank, participation ratio, components for 95 and 99 % of the variance."""
    v = F.abs("eigenvalue")
    total = spectrum.agg(F.sum(v).alias("_t"), F.count(F.lit(1)).alias("_k"))
    p = v / F.col("_t")
    rows = spectrum.crossJoin(F.broadcast(total))  # one row
    entropy = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    t, k = F.first("_t"), F.first("_k")

    def needed(level):
        return F.least(F.count_if(F.col("cumulative") < level) + 1, k)

    sq = F.sum(v * v)
    return rows.agg(
        F.when(t == 0, 0.0).otherwise(F.exp(entropy)).alias("effective_rank"),
        F.when(sq == 0, 0.0).otherwise(t * t / sq).alias("participation_ratio"),
        needed(0.95).alias("variance_95_dims"), needed(0.99).alias("variance_99_dims"),
    )


def _unit(vec: str) -> Column:
    x = F.col(vec).cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e-8))
    return let(norm, lambda n: F.transform(x, lambda v: v / n))


def sampled_pairs(df: DataFrame, n_pairs: int, id_col: str, vec: str = "embedding", seed: int = 42):
    """(pair, u, v): unit vectors of ``n_pairs`` hashed pairs of different rows.

    Rows are numbered by a shuffled rank and each pair names two numbers. The short
    pair list is sent to the vectors, not the vectors to the pairs.
    """
    from cohortspark.functions.hashing import cell_uniform
    from cohortspark.operators.ordering import hash_rank

    ranked = hash_rank(df.select(id_col), [id_col], seed).select(id_col, F.col("rank"))
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    pairs = df.sparkSession.range(n_pairs).withColumnRenamed("id", "pair").crossJoin(F.broadcast(size))
    i = F.floor(cell_uniform(seed, "pair", F.lit("i")) * F.col("_n"))
    step = 1 + F.floor(cell_uniform(seed, "pair", F.lit("j")) * (F.col("_n") - 1))
    limit = F.least(F.lit(n_pairs), (F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint"))
    pairs = pairs.filter((F.col("_n") > 1) & (F.col("pair") < limit)).select(
        "pair", i.alias("i"), F.pmod(i + step, F.col("_n")).alias("j")
    )
    sides = []
    for end, out in (("i", "u"), ("j", "v")):
        wanted = pairs.select("pair", F.col(end).alias("rank"))
        if n_pairs <= BROADCAST_PAIRS:  # two numbers per pair
            wanted = F.broadcast(wanted)
        ids = ranked.join(wanted, "rank").select("pair", id_col)
        ids = F.broadcast(ids) if n_pairs <= BROADCAST_PAIRS else ids
        sides.append(df.join(ids, id_col).select("pair", _unit(vec).alias(out)))
    return sides[0].join(sides[1], "pair")


def pair_similarity(pairs: DataFrame, t: float = 2.0) -> DataFrame:
    """Mean and population std of the cosines, and log mean exp(-t * squared distance)."""
    prod = F.zip_with("u", "v", lambda a, b: a * b)
    cos = F.aggregate(prod, F.lit(0.0), lambda a, x: a + x)
    gap = F.zip_with("u", "v", lambda a, b: (a - b) * (a - b))
    sq = F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)
    return pairs.agg(
        F.coalesce(F.avg(cos), F.lit(0.0)).alias("mean_cosine"),
        F.coalesce(F.stddev_pop(cos), F.lit(0.0)).alias("std_cosine"),
        F.coalesce(F.log(F.avg(F.exp(-t * sq))), F.lit(0.0)).alias("uniformity"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def collapse(dims: DataFrame, similarity: DataFrame, cosine_limit: float = 0.95) -> DataFrame:
    """Dead dimensions, collapse score and flag."""
    dead = dims.agg(
        F.count_if(F.col("std") < DEAD_STD).alias("dead_dimensions"),
        F.count(F.lit(1)).alias("embedding_dim"),
    )
    both = dead.crossJoin(F.broadcast(similarity))  # two one-row frames
    high = F.col("mean_cosine") > cosine_limit
    score = (
        F.when(high, 0.4).otherwise(0.0) + 0.3 * F.col("dead_dimensions") / F.col("embedding_dim")
        + 0.3 * F.least(F.lit(1.0), F.col("uniformity") / 5.0)
    )
    return both.withColumn("collapse_score", F.least(F.lit(1.0), score)).withColumn(
        "is_collapsed", (score > 0.5) | high
    )


def quality_report(
    df: DataFrame, id_col: str, vec: str = "embedding", n_pairs: int = 10000, seed: int = 42
) -> DataFrame:
    """All diagnostics in one row, with rule-based ``warnings`` and ``recommendations``.

    Cosines are those of all pairs; only the uniformity comes from ``n_pairs`` sampled ones.
    """
    basic = global_stats(df, vec).drop("embedding_dim")
    shape = dimensionality(eigenvalues(df, vec))
    spread = pair_similarity(sampled_pairs(df, n_pairs, id_col, vec, seed)).select("uniformity")
    pairs = cosine_moments(df, vec).crossJoin(spread)  # two one-row frames
    fall = collapse(dim_stats(df, vec), pairs)
    row = basic.crossJoin(shape).crossJoin(fall)  # three one-row frames
    dim = F.col("embedding_dim")
    flat = F.col("effective_rank") < dim * 0.1
    similar = F.col("mean_cosine") > 0.8
    rules = [
        (F.col("is_collapsed"), "collapsed", "use a contrastive loss or a larger model"),
        (F.col("dead_dimensions") / dim > 0.1, "dead dimensions",
         "use a smaller embedding or regularization"),
        (flat, "low effective rank", "use a larger model or train longer"),
        (similar, "high mean cosine similarity", None),
        (similar & (F.col("mean_cosine") < 0.95), None, "watch the training, vectors grow alike"),
        (F.col("variance_95_dims") < dim * 0.1, "variance in few dimensions", None),
    ]

    def texts(i):
        items = [F.when(r[0], F.lit(r[i])) for r in rules if r[i]]
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    return row.withColumns({"warnings": texts(1), "recommendations": texts(2)})


def compare(a: DataFrame, b: DataFrame, id_col: str, names=("A", "B"), **kw) -> DataFrame:
    """Both reports side by side, one row per set."""
    keep = ["n_samples", "global_mean", "global_std", "effective_rank", "variance_95_dims",
            "is_collapsed", "mean_cosine", "dead_dimensions"]
    parts = [
        quality_report(x, id_col, **kw).select(F.lit(n).alias("set"), *keep)
        for x, n in zip((a, b), names)
    ]
    return parts[0].unionByName(parts[1])


def encode(df: DataFrame, fn, id_col: str, max_samples: int | None = None) -> DataFrame:
    """Vectors from a caller's encoder, applied to Arrow batches; ``max_samples`` caps the input."""
    rows = df if max_samples is None else df.orderBy(id_col).limit(max_samples)
    schema = T.StructType(
        [df.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return rows.mapInPandas(run, schema)
