"""Operator 6: exact top-k by inner product with multi-resolution segment statistics.

For vectors cut into segments of equal length, the mean and deviation of each segment bound the
squared distance from below: sum of L * ((difference of means)^2 + (difference of deviations)^2).
With the lengths of both vectors that bounds their inner product from above. Bounds are taken from
coarse to fine segments; what stays above the k-th best exact score so far goes to the next level,
and the survivors are scored exactly in integers. No row is left out that could be in the result.

Components are floor(256 * x) of the double x. Rows whose vector is null, holds null or a
non-finite component take no part; a shorter vector counts as filled up with zeros; an empty vector
scores zero. Repeated rows are candidates each, and each asks, as the query's SQL says. Scores beyond 64 bits are exact inside and
are returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.tiles import best, search, usable

SEED = 64  # candidates of the best coarse bound that give the first threshold
MOST = 2.0**62


class Levels:
    """Segment means and deviations of many vectors at several resolutions, coarse to fine."""

    def __init__(self, vecs: np.ndarray, coarsest: int = 2):
        n, width = vecs.shape
        self.power = (vecs * vecs).sum(axis=1)
        self.levels = []
        segments = coarsest
        while segments < width:
            size = -(-width // segments)
            padded = np.zeros((n, size * segments))
            padded[:, :width] = vecs
            parts = padded.reshape(n, segments, size)
            self.levels.append((size, parts.mean(axis=2), parts.std(axis=2)))
            segments *= 4

    def bounds(self, level: int, query: tuple[float, np.ndarray, np.ndarray], rows: np.ndarray | slice) -> np.ndarray:
        """Upper bounds of the inner products of a query with ``rows``, from lower bounds of distances."""
        size, means, devs = self.levels[level]
        power, mean, dev = query
        own = self.power[rows]
        apart = ((means[rows] - mean) ** 2 + (devs[rows] - dev) ** 2).sum(axis=1) * size
        return (own + power - apart) / 2 + 1e-9 * (own + power)


def exact(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    if small:
        return rows.astype(np.int64) @ query.astype(np.int64)
    wide = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in rows.tolist()]
    return np.array(wide, object)


def tile_search(k: int):
    def tile(query_ids, queries, row_ids, rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        queries, rows = np.floor(queries * 256), np.floor(rows * 256)
        largest = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0))
        small = largest * largest * max(rows.shape[1], 1) < MOST and largest < MOST
        own, asked = Levels(rows), Levels(queries)
        for i, query_id in enumerate(query_ids.tolist()):
            alive = np.flatnonzero(row_ids != query_id)
            query = queries[i]
            floor = None
            for level in range(len(own.levels) if small else 0):
                stats = (asked.power[i], asked.levels[level][1][i], asked.levels[level][2][i])
                bounds = own.bounds(level, stats, alive)
                if floor is None and len(alive) > SEED >= k:  # the k-th best of some rows is a floor for all
                    first = alive[np.argpartition(-bounds, SEED)[:SEED]]
                    floor = np.partition(exact(rows[first], query, small), SEED - k)[SEED - k]
                if floor is not None:
                    alive = alive[bounds >= floor]
            scores = exact(rows[alive], query, small)
            if not small:
                chosen = sorted(range(len(alive)), key=lambda j: (-scores[j], row_ids[alive[j]]))[:k]
                yield query_id, row_ids[alive[chosen]], np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores[chosen]], np.int64)
                continue
            chosen = best(row_ids[alive], scores, k)
            yield query_id, row_ids[alive[chosen]], scores[chosen]

    return tile


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Per query its ``k`` highest integer inner products: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``; the query's own id is no candidate.
    """
    found = search(usable(vectors, id_col, vec_col), is_query, k, "bigint", tile_search(k))
    return found.withColumn("rank", F.col("rank").cast("int"))
