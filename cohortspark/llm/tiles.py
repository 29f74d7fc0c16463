"""Searches of a stated query set against all rows, in tiles of bounded size.

Rows and queries are numbered into blocks by a hash of their id. A tile is one block of queries
against one block of rows and runs in one task; rows are copied once per query block. Each tile
returns its own best rows per query, and the final ranks are taken over the tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import ship
from cohortspark.session import stage

QUERY_BLOCK = 4096
ROW_BLOCK = 16384


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: id and vector without nulls or non-finite components; repeated rows are kept."""
    vec = F.col("vec").cast(T.ArrayType(T.DoubleType()))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() :]
    width = int(max(sizes.max(initial=0), width or 0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat[: sizes.sum()]
    return out


def search(
    rows: DataFrame, is_query, k: int, score_type: str,
    tile: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    once: bool = False,
) -> DataFrame:
    """Best ``k`` rows per query: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Repeated rows are candidates each. Repeats of a query's row all ask, so that each candidate stands in its ranks as often;
    with ``once`` rows of equal id and vector ask once.
    ``tile(query_ids, queries, row_ids, rows)`` yields per query the ids and scores of at least its ``k`` best rows.
    """
    rows = stage(rows, "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, math.ceil(n / ROW_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))

    def block(blocks: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = rows.select("vec_id", "vec", F.lit(False).alias("asks"), block(row_blocks).alias("row_block"), every(query_blocks).alias("query_block"))
    asked = rows.where(is_query).select("vec_id", "vec", F.lit(True).alias("asks"), block(query_blocks).alias("query_block"), every(row_blocks).alias("row_block"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        vecs, ids = matrix(table.column("vec")), table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        q, r = order[asks[order]], order[~asks[order]]
        if once and len(np.unique(ids[q])) < len(q):  # all rows of an id are in one block
            q = np.array(list({(ids[i], (vecs[i] + 0.0).tobytes()): i for i in q[::-1]}.values()))[::-1]
        out: list[list] = [[], [], []]
        for query, found, scores in tile(ids[q], vecs[q], ids[r], vecs[r]):
            out[0].append(np.full(len(found), query))
            out[1].append(found)
            out[2].append(scores)
        arrays = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        types = [table.schema.field("vec_id").type] * 2 + [kinds[score_type]]
        return pa.table([pa.array(a.astype(t.to_pandas_dtype()), t) for a, t in zip(arrays, types, strict=True)], names=["query_id", "vec_id", "score"])

    ship(rows.sparkSession)
    found = (
        sides.unionByName(asked).groupBy("query_block", "row_block")
        .applyInArrow(run, f"query_id {id_type}, vec_id {id_type}, score {score_type}")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]
