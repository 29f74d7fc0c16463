"""Operator 9: approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are taken relative to a centre, scaled to length one and rotated at random into
``bits`` dimensions; the signs are the code. The inner product of a vector with its own code corrects the
estimate, and bounds its error: with probability set by ``errors`` the true product lies within
|q| |v| sqrt((1 - f^2) / f^2) * errors / sqrt(bits - 1) of the estimate, for f that inner product. All
vectors whose upper bound reaches the k-th best lower bound, or the k-th best exact score found
so far, are reranked by the exact inner product on the original vectors in double precision.

Every row is coded; the centre is the mean of a bounded sample of rows and only sets how tight the
bounds are. Rows whose vector is null, zero, or holds null or a non-finite component take no part.
Equal vectors have equal scores; ties go to the smaller id. A shorter vector counts as filled
up with zeros. A query whose row is repeated asks once; repeated rows are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.tiles import best, search, usable

SAMPLE = 4096  # rows whose mean is the centre


def rotation(width: int, bits: int, seed: int = 7) -> np.ndarray:
    """Orthonormal columns: ``width`` dimensions turned at random into ``bits`` dimensions."""
    made, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return made[:, :width].copy()


class Codes:
    """Packed sign codes of vectors and the scalars that correct their estimates."""

    def __init__(self, vecs: np.ndarray, turn: np.ndarray, centre: np.ndarray):
        self.bits = len(turn)
        away = vecs - centre
        self.length = np.sqrt((away * away).sum(axis=1))
        unit = away / np.where(self.length, self.length, 1)[:, None]
        turned = unit @ turn.T
        self.packed = np.packbits(turned > 0, axis=1)
        self.fit = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.bits), 1e-9)
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit

    def estimates(self, turned: np.ndarray) -> np.ndarray:
        """Estimated inner products of rotated queries with the unit vectors, queries x vectors."""
        signs = np.unpackbits(self.packed, axis=1, count=self.bits).astype(np.float32) * 2 - 1
        return (turned.astype(np.float32) @ signs.T) / (np.sqrt(self.bits) * self.fit).astype(np.float32)


def tile_search(k: int, bits: int, errors: float):
    def tile(query_ids, queries, row_ids, rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keep = (rows != 0).any(axis=1)
        row_ids, rows = row_ids[keep], rows[keep]
        asks = (queries != 0).any(axis=1)
        query_ids, queries = query_ids[asks], queries[asks]
        if not len(rows) or not len(queries):
            return
        width = max(rows.shape[1], 1)
        turn = rotation(width, max(bits, width))
        centre = rows[:SAMPLE].mean(axis=0)
        codes = Codes(rows, turn, centre)
        for start in range(0, len(queries), 128):
            block = queries[start : start + 128]
            base = block @ centre
            size = np.sqrt((block * block).sum(axis=1))
            guess = codes.estimates(block @ turn.T).astype(np.float64) * codes.length + base[:, None]
            slack = size[:, None] * (codes.length * codes.spread * errors / np.sqrt(codes.bits - 1)) + 1e-6 * size[:, None] * codes.length
            for i, query_id in enumerate(query_ids[start : start + 128].tolist()):
                others = np.flatnonzero(row_ids != query_id)
                upper = guess[i, others] + slack[i, others]
                if len(others) > k:
                    lower = guess[i, others] - slack[i, others]
                    floor = np.partition(lower, len(lower) - k)[len(lower) - k]
                    sure = others[np.argpartition(-upper, k)[: 2 * k]]
                    floor = max(floor, np.partition((rows[sure] * block[i]).sum(axis=1), len(sure) - k)[len(sure) - k])
                    others = others[upper >= floor]
                scores = (rows[others] * block[i]).sum(axis=1)
                chosen = best(row_ids[others], scores, k)
                yield query_id, row_ids[others[chosen]], scores[chosen]

    return tile


def nearest(vectors: DataFrame, is_query, k: int = 20, bits: int = 256, errors: float = 3.0, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Per query the ``k`` largest inner products found: query_id, rank, vec_id, score (double).

    ``is_query`` is a condition on ``vec_id``; the query's own id is no candidate.
    """
    rows = usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    found = search(rows, is_query, k, "double", tile_search(k, bits, errors), once=True)
    return found.withColumn("rank", F.col("rank").cast("int"))
