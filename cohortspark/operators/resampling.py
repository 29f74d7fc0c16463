"""Resampling weights and mergeable metric states.

A bootstrap replicate gives every row a Poisson(1) weight. Rows with equal numbers collapse to one cell with a
count, and the cell's weight is one Poisson(count) draw, made of draws for the binary digits of the count. A draw
inverts a uniform that is mixed from the cell's MD5 key, the replicate and the digit in whole-number
arithmetic, so SQL can repeat it.

A metric is a list of features of a row and a function of their weighted sums. Sums of tasks add up, so a
replicate's state is a few numbers, whatever the number of rows; no row is copied per replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.hashing import stable_draw

NAN = float("nan")
PRIME = 2**31 - 1
TOP = 9  # counts from 2**TOP on are drawn in units of 2**TOP
ROWS = 1024  # cells whose weights are held at once
GROUPS = 256  # groups whose sums a task holds before it hands them on
BINS = 15


# --- weights --------------------------------------------------------------------------------

def whole_key(c: Column) -> Column:
    """A number of 40 bits for a double, by whole billionths; -1 for what is not finite."""
    y = c.cast("double") * 1e9
    ok = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf")))
    return F.when(ok, F.floor(y - F.floor(y / 2.0**40).cast("double") * 2.0**40)).otherwise(F.lit(-1)).cast("bigint")


def cell_key(seed: int, by: Sequence[str], doubles: Sequence) -> Column:
    """The number below 2**31 - 1 that fixes a cell's draws."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    cols += [whole_key(F.col(c) if isinstance(c, str) else c) for c in doubles]
    return F.pmod(stable_draw(seed, *cols), F.lit(PRIME))


def uniform(key: np.ndarray, replicate: np.ndarray, digit: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from key, replicate and digit."""
    at = replicate * 7919 + digit * 104729
    x = (key * 48271 + at * 16807 + 12345) % PRIME
    x ^= x >> 13
    x = (x * 1566083941 + at) % PRIME
    x ^= x >> 16
    x = (x * 1103515245 + 7) % PRIME
    x ^= x >> 15
    return (x + 0.5) / 2147483648.0


def _steps(mean: int) -> np.ndarray:
    """Distribution function of a Poisson count, as far as it can be told from 1."""
    term, total, out, k = np.exp(-float(mean)), 0.0, [], 0
    while total < 1.0 - 1e-13 and k < 2 * mean + 60:
        total += term
        out.append(total)
        k += 1
        term = term * mean / k
    return np.array(out)


STEPS = [_steps(1 << j) for j in range(TOP + 1)]


def weights(key: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(cells x n) weights of cells that stand for ``count`` rows each."""
    replicate = np.arange(1, n + 1, dtype=np.int64)[None, :]
    out = np.zeros((len(key), n), np.int64)
    for j in range(TOP):
        own = np.flatnonzero(count >> j & 1)
        if len(own):
            out[own] += np.searchsorted(STEPS[j], uniform(key[own, None], replicate, j), "right")
    units = count >> TOP
    own, before = np.repeat(np.arange(len(key)), units), np.cumsum(units) - units
    for lo in range(0, len(own), ROWS):
        part = own[lo : lo + ROWS]
        digit = TOP + np.arange(lo, lo + len(part)) - before[part]
        draws = np.searchsorted(STEPS[TOP], uniform(key[part, None], replicate, digit[:, None]), "right")
        np.add.at(out, part, draws)
    return out


# --- metrics --------------------------------------------------------------------------------

@dataclass(frozen=True)
class WeightedSums:
    """A metric by its state: weighted sums of a row's ``features``, and ``value`` of the sums.

    ``features`` maps a pandas frame with the columns ``inputs`` to a (rows x ``size``) array, and
    ``value`` a (replicates x ``size``) array of sums to a number each, NaN where it is not defined.
    """

    size: int
    features: Callable[[pd.DataFrame], np.ndarray]
    value: Callable[[np.ndarray], np.ndarray]
    inputs: tuple[str, ...] = field(default=("prediction", "label"))


def share(a: np.ndarray, b: np.ndarray, empty: float = 0.0) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), empty), where=b > 0)


def _table(threshold: float) -> Callable[[pd.DataFrame], np.ndarray]:
    def features(rows: pd.DataFrame) -> np.ndarray:
        hit, y = rows["prediction"].to_numpy(float) >= threshold, rows["label"].to_numpy(float)
        return np.stack([hit & (y == 1), hit & (y == 0), ~hit & (y == 0), ~hit & (y == 1)], axis=1).astype(float)

    return features


def _moments(rows: pd.DataFrame) -> np.ndarray:
    y = rows["label"].to_numpy(float)
    e = rows["prediction"].to_numpy(float) - y
    return np.stack([np.ones(len(y)), e * e, np.abs(e), y, y * y], axis=1)


def _bins(rows: pd.DataFrame) -> np.ndarray:
    p, y = rows["prediction"].to_numpy(float), rows["label"].to_numpy(float)
    at = np.clip(np.floor(p * BINS), 0, BINS - 1).astype(int)
    out = np.zeros((len(p), BINS, 3))
    out[np.arange(len(p)), at] = np.stack([np.ones(len(p)), p, y], axis=1)
    return out.reshape(len(p), -1)


def _r2(s: np.ndarray) -> np.ndarray:
    spread = s[:, 4] - share(s[:, 3] ** 2, s[:, 0])
    return 1.0 - share(s[:, 1], spread, NAN)


def _gap(s: np.ndarray) -> np.ndarray:
    n, p, y = np.moveaxis(s.reshape(len(s), BINS, 3), 2, 0)
    return share(np.abs(p - y).sum(axis=1), n.sum(axis=1), NAN)


def metric_states(threshold: float = 0.5) -> dict[str, WeightedSums]:
    """The metrics that are functions of weighted sums, by name."""
    table = _table(threshold)
    rates = {
        "accuracy": lambda s: share(s[:, 0] + s[:, 2], s.sum(axis=1)),
        "precision": lambda s: share(s[:, 0], s[:, 0] + s[:, 1]),
        "recall": lambda s: share(s[:, 0], s[:, 0] + s[:, 3]),
        "specificity": lambda s: share(s[:, 2], s[:, 2] + s[:, 1]),
        "f1": lambda s: share(2 * s[:, 0], 2 * s[:, 0] + s[:, 1] + s[:, 3]),
        "positive_rate": lambda s: share(s[:, 0] + s[:, 3], s.sum(axis=1), NAN),
    }
    errors = {
        "mse": lambda s: share(s[:, 1], s[:, 0], NAN), "mae": lambda s: share(s[:, 2], s[:, 0], NAN),
        "rmse": lambda s: np.sqrt(share(s[:, 1], s[:, 0], NAN)), "r2": _r2,
    }
    out = {k: WeightedSums(4, table, f) for k, f in rates.items()}
    out |= {k: WeightedSums(5, _moments, f) for k, f in errors.items()}
    return out | {"brier_score": out["mse"], "ece": WeightedSums(3 * BINS, _bins, _gap)}


# --- replicates -------------------------------------------------------------------------------

def replicates(
    df: DataFrame, metrics: dict[str, WeightedSums], n: int, seed: int, by: Sequence[str] = (),
    sides: dict[str, str] | None = None,
) -> DataFrame:
    """Per group and replicate the value of every metric; replicate 0 is that of the rows themselves.

    ``sides`` maps the suffix of a result to the column that stands for ``prediction``; all of them
    share the weights. Rows with a null input are left out. A task keeps the sums of at most a few hundred
    groups and hands on n + 1 rows for each.
    """
    by, sides = list(by), dict(sides or {"": "prediction"})
    used = sorted({c for m in metrics.values() for c in m.inputs})
    columns = [c for c in used if c != "prediction"]
    if "prediction" in used:
        columns = [*dict.fromkeys(sides.values()), *columns]
    shapes = {c: df.schema[c].dataType for c in columns}
    known = df.dropna(subset=columns).select(*by, *columns)
    cells = known.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("_c"))
    numbers = [c for c in columns if not isinstance(shapes[c], T.ArrayType)]
    texts = [F.col(c).cast("string") for c in columns if c not in numbers]
    key = F.pmod(stable_draw(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], *texts, *[whole_key(F.col(c)) for c in numbers]), F.lit(PRIME))
    keyed = cells.withColumn("_h", key)
    # metrics that share features share their sums
    states: dict[tuple, tuple[int, int]] = {}
    place: dict[str, tuple[int, int]] = {}
    width = 0
    for suffix in sides:
        for name, m in metrics.items():
            state = (suffix, m.features, m.inputs)
            if state not in states:
                states[state] = (width, width + m.size)
                width += m.size
            place[name + suffix] = states[state]
    sums_of = [f"_s{i}" for i in range(width)]

    def features(rows: pd.DataFrame) -> np.ndarray:
        parts = []
        for suffix, made, inputs in states:
            view = pd.DataFrame({c: rows[sides[suffix] if c == "prediction" else c] for c in inputs}, index=rows.index)
            parts.append(made(view))
        return np.concatenate(parts, axis=1)

    def frames(sums: dict) -> Iterator[pd.DataFrame]:
        for g, total in sums.items():
            out = pd.DataFrame(total, columns=sums_of)
            out.insert(0, "replicate", np.arange(n + 1))
            for c, v in zip(reversed(by), reversed(g), strict=True):
                out.insert(0, c, v)
            yield out

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False).indices.items() if by else (((), np.arange(len(pdf))),)
            for g, rows in groups:
                g = g if isinstance(g, tuple) else (g,)
                if g not in sums and len(sums) >= GROUPS:
                    yield from frames(sums)
                    sums = {}
                total = sums.setdefault(g, np.zeros((n + 1, width)))
                for lo in range(0, len(rows), ROWS):
                    part = pdf.iloc[rows[lo : lo + ROWS]]
                    x, count = features(part), part["_c"].to_numpy(np.int64)
                    total[0] += count @ x
                    total[1:] += weights(part["_h"].to_numpy(np.int64), count, n).T @ x
        yield from frames(sums)

    kinds = [df.schema[c] for c in by] + [T.StructField("replicate", T.IntegerType())]
    folded = keyed.mapInPandas(fold, T.StructType([*kinds, *[T.StructField(c, T.DoubleType()) for c in sums_of]]))
    sums = folded.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in sums_of])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*by, "replicate"]].copy()
            total = pdf[sums_of].to_numpy(float)
            for suffix in sides:
                for name, m in metrics.items():
                    lo, hi = place[name + suffix]
                    out[name + suffix] = np.asarray(m.value(total[:, lo:hi]), float)
            yield out

    done = sums.mapInPandas(finish, T.StructType([*kinds, *[T.StructField(c, T.DoubleType()) for c in place]]))
    return done.select(*by, "replicate", *[F.coalesce(c, F.lit(NAN)).alias(c) for c in place])  # pandas has no NaN beside null


# --- the same draws in SQL --------------------------------------------------------------------

def draws_sql(cells: str, n: int) -> str:
    """SQL subqueries that add ``replicate`` and ``weight`` to ``cells`` (with ``h`` and ``c``, one row per cell): ``drawn``."""
    at = "(replicate * 7919 + digit * 104729)"
    mixed = f"(h * 48271 + {at} * 16807 + 12345) % {PRIME}"
    return f"""
bumps(j, mean, k, term, total) AS (
  SELECT j, 1 << j, 0, exp(-CAST(1 << j AS DOUBLE)), exp(-CAST(1 << j AS DOUBLE)) FROM range({TOP + 1}) t(j)
  UNION ALL SELECT j, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM bumps
  WHERE total < 1.0 - 1e-13 AND k + 1 < 2 * mean + 60
), steps AS (SELECT j, list(total ORDER BY k) AS steps FROM bumps GROUP BY j),
digits AS (
  SELECT *, unnest(list_concat(list_filter(range({TOP}), lambda j: (c >> j) & 1 = 1), range({TOP}, {TOP} + (c >> {TOP})))) AS digit FROM {cells}
), mixed AS (
  SELECT *, xor(x3, x3 >> 15) AS x FROM (SELECT *, (xor(x2, x2 >> 16) * 1103515245 + 7) % {PRIME} AS x3 FROM (
    SELECT *, (xor(x1, x1 >> 13) * 1566083941 + {at}) % {PRIME} AS x2 FROM (
      SELECT *, {mixed} AS x1 FROM digits, range(1, {n} + 1) r(replicate))))
), drawn AS (
  SELECT h, replicate, CAST(sum(len(list_filter(steps, lambda s: s <= (x + 0.5) / 2147483648.0))) AS BIGINT) AS weight
  FROM mixed JOIN steps ON j = least(digit, {TOP}) GROUP BY h, replicate
)"""


def key_sql(seed: int, by: Sequence[str], doubles: Sequence[str]) -> str:
    """SQL for ``cell_key``."""
    parts = [f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in by]]
    for c in doubles:
        y = f"(CAST({c} AS DOUBLE) * 1e9)"
        parts.append(f"CAST(CASE WHEN isfinite({y}) THEN CAST(floor({y} - floor({y} / 1099511627776.0) * 1099511627776.0) AS BIGINT) ELSE -1 END AS VARCHAR)")
    return f"CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 15) AS BIGINT) % {PRIME}"
