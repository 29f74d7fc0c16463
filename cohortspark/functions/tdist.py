"""Student-t quantiles: a table by rule for small samples, a series beyond it."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_975 = 1.959963984540054
TABLE_DF = 60


def _central_mass(t: float, df: int) -> float:
    """P(|T| <= t) by the finite trigonometric sums for whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    if df == 1:
        return 2.0 * theta / math.pi
    term, total = 1.0, 1.0
    first = 2 if df % 2 == 0 else 3
    for k in range(first, df - 1, 2):
        term *= c2 * (k - 1) / k
        total += term
    if df % 2 == 0:
        return math.sin(theta) * total
    return 2.0 / math.pi * (theta + math.sin(theta) * math.cos(theta) * total)


@lru_cache
def t_table(most: int = TABLE_DF, mass: float = 0.95) -> tuple[float, ...]:
    """Two-sided quantiles for df = 1 .. most, by bisection."""
    out = []
    for df in range(1, most + 1):
        lo, hi = 0.0, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2.0
            lo, hi = (mid, hi) if _central_mass(mid, df) < mass else (lo, mid)
        out.append((lo + hi) / 2.0)
    return tuple(out)


def t_975(df: Column) -> Column:
    """The 97.5 % quantile for a column of degrees of freedom (null below 1)."""
    z = Z_975
    g1 = (z**3 + z) / 4.0
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160.0
    d = df.cast("double")
    series = F.lit(z) + g1 / d + g2 / d**2 + g3 / d**3 + g4 / d**4
    table = F.array(*[F.lit(x) for x in t_table()])
    return F.when(df < 1, F.lit(None)).when(df <= TABLE_DF, F.get(table, df.cast("int") - 1)).otherwise(
        series
    )
