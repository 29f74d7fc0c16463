"""Keyed draws: the same row gets the same number on any partitioning.

``stable_draw`` hashes text with MD5, so any SQL engine can repeat it; ``stable_uniform``
and ``stable_normal`` are made of it, for masks and noise. ``cell_uniform`` uses the much
cheaper 64-bit hash for resampling, which draws once per row and replicate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def stable_draw(seed: int, *cols) -> Column:
    """A whole number in [0, 2**60) from the seed and the columns' text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_as_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_bucket(draw: Column, bits: int) -> Column:
    """The leading ``bits`` of a stable draw: order-preserving, evenly filled."""
    return F.shiftright(draw, DRAW_BITS - bits).cast("int")


def stable_uniform(seed: int, *cols) -> Column:
    """A double in [0, 1] from a stable draw."""
    return stable_draw(seed, *cols).cast("double") * F.lit(2.0 ** -DRAW_BITS)


def stable_normal(seed: int, *cols) -> Column:
    """A standard normal draw per cell (two uniforms, polar form)."""
    u1 = F.greatest(stable_uniform(seed, *cols, F.lit("r")), F.lit(2.0 ** -DRAW_BITS))
    u2 = stable_uniform(seed, *cols, F.lit("a"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def cell_uniform(seed: int, *cols) -> Column:
    """A double in [0, 1) from the fast 64-bit hash."""
    h = F.xxhash64(F.lit(int(seed)), *[_as_col(c) for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0 ** -53)


def poisson_one(u: Column, most: int = 12) -> Column:
    """Poisson(1) counts by inverting a uniform; the tail past ``most`` is < 1e-10."""
    out = F.lit(0)
    cumulative, term = 0.0, math.exp(-1.0)
    for k in range(most):
        cumulative += term
        out = out + F.when(u >= F.lit(cumulative), 1).otherwise(0)
        term /= k + 1
    return out


def set_fingerprint(col) -> Column:
    """Order-free aggregate hash of a column's values (use inside ``agg``)."""
    h = F.xxhash64(_as_col(col))
    return F.sha2(
        F.concat_ws(
            ":",
            F.count(F.lit(1)).cast("string"),
            F.bit_xor(h).cast("string"),
            F.sum(F.pmod(h, F.lit(1 << 31))).cast("string"),
        ),
        256,
    )


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
