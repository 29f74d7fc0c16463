"""Operator 5: reversible line de-duplication with sharded cuckoo filters and exact counts.

An index over lines holds three staged tables, all dealt by a shard of the key's hash:

* ``postings``: one row per key and document that has it;
* ``counts``: the exact reference count of every key, its smallest document, and the batch that
  brought the key;
* ``filters``: per shard and batch a cuckoo filter with the fingerprints of the keys the batch brought.

``insert`` asks the filters about the keys of new documents: keys in no filter are new and are only
appended; the rest is merged with the counts, which settle false alarms. ``delete`` takes postings
away, counts down, and removes the fingerprints of keys that no document holds any more, from the
filter that holds them. Both return a new index and leave the old one as it is, so a lost driver
costs one batch. ``drops`` lists the keys each document loses, ``keep_lines`` applies them.

Null and empty texts are one empty line. A row without a document id is not indexed and keeps all
its lines. Rows that share an id count as one document. An empty table gives an empty index.
A column of the documents named like an added count gives way to it, unless the counts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import WHITE, ship, skew_safe_join, strings, tidy
from cohortspark.session import stage

LEAST = 10  # code points of a key that counts
SLOTS = 4  # fingerprints in a bucket
LOAD = 0.8  # filled part of a filter at most
KEY = ["h1", "h2"]


def keys_of(text: str, least: int = LEAST) -> list[bytes | None]:
    """Per line the 128-bit hash of its key, or None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in text.split("\n"):
        key = line.strip(WHITE)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least else None)
    return out


def postings_of(docs: DataFrame, shards: int, id_col="doc_id", text_col="text", least: int = LEAST) -> DataFrame:
    """One row per document row and distinct key: shard, h1, h2, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, count = [], []
            for text in strings(batch, "text"):
                own = {k for k in keys_of(text, least) if k is not None}
                keys.extend(own)
                count.append(len(own))
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(count)), count)))
            shard = (halves[:, 0].view(np.uint64) >> np.uint64(32)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids], ["shard", *KEY, "doc_id"]
            )

    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(tidy(run), f"shard int, h1 bigint, h2 bigint, doc_id {docs.schema[id_col].dataType.simpleString()}")


class CuckooFilter:
    """Partial-key cuckoo filter over 128-bit keys, filled and asked many keys at a time."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x slots of 16-bit fingerprints, 0 is a free slot

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < max(n, 1):
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (h2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (h1.view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        mixed = mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
        return at ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, at = self.places(h1, h2)
        here = (self.table[at] == mark[:, None]).any(axis=1)
        return here | (self.table[self.other(mark, at)] == mark[:, None]).any(axis=1)

    def settle(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; returns which found none."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else order
        turn = np.arange(len(bucket)) - np.repeat(first, np.diff(np.r_[first, len(bucket)]))
        free = self.table[bucket] == 0
        fits = turn < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (turn + 1)[:, None]).argmax(axis=1)
        self.table[bucket[fits], slot[fits]] = mark[order[fits]]
        left = np.ones(len(at), bool)
        left[order[fits]] = False
        return left

    def add(self, h1: np.ndarray, h2: np.ndarray, rounds: int = 500) -> bool:
        """Add distinct keys; False if some found no place, then the filter has to be made larger."""
        mark, at = self.places(h1, h2)
        left = self.settle(mark, at)
        mark, at = mark[left], self.other(mark[left], at[left])
        for turn in range(rounds):
            left = self.settle(mark, at)
            mark, at = mark[left], at[left]
            if not len(mark):
                return True
            # one fingerprint of a full bucket makes room and goes to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = (at[one] + turn) % SLOTS
            moved = self.table[at[one], slot].copy()
            self.table[at[one], slot] = mark[one]
            mark[one] = moved
            at[one] = self.other(moved, at[one])
        return False

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove keys that were added; of equal fingerprints in a bucket pair any may go."""
        mark, at = self.places(h1, h2)
        for m, a, b in zip(mark.tolist(), at.tolist(), self.other(mark, at).tolist(), strict=True):
            for bucket in (a, b):
                slot = np.flatnonzero(self.table[bucket] == m)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


@dataclass(frozen=True)
class LineIndex:
    """The state after a number of batches; every table is staged, none is changed in place."""

    spark: SparkSession
    shards: int
    id_type: str
    batches: int = 0
    postings: tuple[DataFrame, ...] = ()
    counts: DataFrame | None = None
    filters: tuple[DataFrame, ...] = ()


def new_index(docs: DataFrame, id_col: str = "doc_id", shards: int | None = None) -> LineIndex:
    """An empty index for documents like ``docs``; by default four shards per shuffle partition."""
    spark = docs.sparkSession
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    return LineIndex(spark, shards, kind)


def insert(index: LineIndex, postings: DataFrame) -> LineIndex:
    """The index with the documents of ``postings`` added; documents that are in it stay once."""
    batch = index.batches
    postings = postings.dropDuplicates()
    if index.postings:  # what a document had already is no new reference
        known = reduce(DataFrame.unionByName, index.postings)
        postings = postings.join(known, [*KEY, "doc_id"], "left_anti")
    postings = stage(postings, "line-postings")
    fresh = postings.groupBy("shard", *KEY).agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")
    )
    if index.counts is None:
        counts = stage(fresh.withColumn("batch", F.lit(batch)), "line-counts")
        brought = counts
    else:
        asked = stage(_ask(fresh, index), "line-asked")
        known = asked.where("maybe").drop("maybe")
        both = index.counts.join(known.withColumnsRenamed({"n_docs": "more", "first_doc": "other"}), ["shard", *KEY], "full_outer")
        merged = both.select(
            "shard", *KEY,
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.least("first_doc", "other").alias("first_doc"), F.coalesce("batch", F.lit(batch)).alias("batch"),
        )
        new = asked.where("NOT maybe").drop("maybe").withColumn("batch", F.lit(batch))
        counts = stage(merged.unionByName(new), "line-counts")
        brought = counts.where(F.col("batch") == batch)
    filters = stage(_build(brought, batch), "line-filters")
    return replace(
        index, batches=batch + 1, postings=(*index.postings, postings), counts=counts, filters=(*index.filters, filters)
    )


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents whose ids are in the one column of ``doc_ids``."""
    if not index.postings:
        return index
    gone = doc_ids.toDF("doc_id").dropna().dropDuplicates()
    postings = reduce(DataFrame.unionByName, index.postings)
    kept = stage(postings.join(gone, "doc_id", "left_anti"), "line-postings")
    touched = postings.join(gone, "doc_id", "left_semi").select("shard", *KEY).distinct()
    left = kept.join(touched, ["shard", *KEY], "left_semi").groupBy("shard", *KEY).agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")
    )
    old = index.counts.join(touched, ["shard", *KEY], "left_semi").select("shard", *KEY, "batch")
    changed = stage(old.join(left, ["shard", *KEY], "left"), "line-changed")
    counts = index.counts.join(touched, ["shard", *KEY], "left_anti").unionByName(
        changed.dropna(subset=["n_docs"]).select(index.counts.columns)
    )
    ended = changed.where("n_docs IS NULL").select("shard", *KEY, "batch")
    filters = stage(_remove(reduce(DataFrame.unionByName, index.filters), ended), "line-filters")
    return replace(index, postings=(kept,), counts=stage(counts, "line-counts"), filters=(filters,))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _build(counts: DataFrame, batch: int) -> DataFrame:
    """A filter per shard with the keys of ``counts``: shard, batch, cells."""

    def run(table: pa.Table) -> pa.Table:
        h1, h2 = _columns(table, *KEY)
        n = len(h1)
        made = CuckooFilter.for_keys(n)
        while not made.add(h1, h2):
            n *= 2
            made = CuckooFilter.for_keys(n)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "batch": pa.array([batch], pa.int32()), "cells": [made.dump()]})

    return counts.select("shard", *KEY).groupBy("shard").applyInArrow(run, "shard int, batch int, cells binary")


def _ask(fresh: DataFrame, index: LineIndex) -> DataFrame:
    """``fresh`` with ``maybe``: whether some filter of the shard has the key."""

    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        h1, h2 = _columns(keys, *KEY)
        maybe = np.zeros(len(h1), bool)
        for raw in filters.column("cells").to_pylist():
            maybe |= CuckooFilter.load(raw).has(h1, h2)
        return keys.append_column("maybe", pa.array(maybe))

    filters = reduce(DataFrame.unionByName, index.filters)
    kinds = f"shard int, h1 bigint, h2 bigint, n_docs bigint, first_doc {index.id_type}, maybe boolean"
    return fresh.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, kinds)


def _remove(filters: DataFrame, ended: DataFrame) -> DataFrame:
    def run(own: pa.Table, keys: pa.Table) -> pa.Table:
        if not len(own) or not len(keys):
            return own
        made = CuckooFilter.load(own.column("cells")[0].as_py())
        made.remove(*_columns(keys, *KEY))
        return own.set_column(own.schema.get_field_index("cells"), "cells", pa.array([made.dump()], pa.binary()))

    return filters.groupBy("shard", "batch").cogroup(ended.groupBy("shard", "batch")).applyInArrow(run, "shard int, batch int, cells binary")


def drops(index: LineIndex) -> DataFrame:
    """Per document, the keys it loses: those another document with a smaller id holds too.

    Columns doc_id and ``keys``, 128-bit hashes one after the other. A document's list is bounded by its lines.
    """
    shared = index.counts.where("n_docs > 1").select(*KEY, "n_docs", "first_doc")
    found = skew_safe_join(reduce(DataFrame.unionByName, index.postings).drop("shard"), shared, KEY, "n_docs")
    return found.where("doc_id <> first_doc").groupBy("doc_id").agg(
        F.collect_list(F.struct(*KEY)).alias("keys")
    )


def keep_lines(docs: DataFrame, dropped: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST, counts: bool = True) -> DataFrame:
    """``docs`` with the lines of the dropped keys taken out of the text.

    With ``counts``, added columns n_lines and n_dropped; a row without drops keeps its text, null stays null.
    """
    taken = [c for c in docs.columns if c not in (id_col, text_col)]
    renamed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(f"_{i}") for i, c in enumerate(taken)])
    joined = renamed.join(dropped, "doc_id", "left")
    rest = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys"), strict=True):
                if text is None or not keys.is_valid:
                    texts.append(text)
                    n_lines.append(text.count("\n") + 1 if text is not None else 1)
                    n_dropped.append(0)
                    continue
                own = keys.values.flatten()
                pairs = np.column_stack([x.to_numpy() for x in own]).astype("<i8").tobytes()
                gone = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
                lines = text.split("\n")
                kept = [line for line, key in zip(lines, keys_of(text, least), strict=True) if key not in gone]
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("keys", "text")}
            out |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    names = ["doc_id", "text", *[f"_{i}" for i in range(len(taken))], "n_lines", "n_dropped"]
    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, {rest + ', ' if rest else ''}n_lines bigint, n_dropped bigint"
    ship(docs.sparkSession)
    done = joined.select("doc_id", "text", *[f"_{i}" for i in range(len(taken))], "keys").mapInArrow(tidy(run), kind)
    inner = {id_col: "doc_id", text_col: "text"} | {c: f"_{i}" for i, c in enumerate(taken)}
    added = ["n_lines", "n_dropped"] if counts else []
    return done.select(*[F.col(inner[c]).alias(c) for c in docs.columns if c.lower() not in added], *added)


def dedup_lines(docs: DataFrame, batches: int = 2, id_col="doc_id", text_col="text", least: int = LEAST, counts: bool = True) -> DataFrame:
    """Index all documents, in ``batches`` insertions by a hash of the id, and take repeated lines out.

    Returns ``docs`` with n_lines and n_dropped if ``counts``, see ``keep_lines``.
    """
    index = new_index(docs, id_col)
    postings = stage(postings_of(docs, index.shards, id_col, text_col, least), "line-hashes")
    for batch in range(batches):
        index = insert(index, postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch))
    return keep_lines(docs, drops(index), id_col, text_col, least, counts)
