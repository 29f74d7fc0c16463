"""Operator 2: near-duplicate documents by MinHash.

Documents are sets of hashed word shingles. Equal sets are one class. Class representatives get the
minima of ``MINIMA`` universal hash functions; representatives with an equal band of minima
share a bucket. Candidates are confirmed by their signatures first, then on the full sets:

1. every member of a bucket is paired with the bucket's smallest id;
2. members whose signature is too far from that one's are compared with all other members, in tiles, first by
   signatures, which leaves the members that are near to another one, then by their full sets;
3. pairs of step 1 are confirmed on the full sets, one per document first, then those whose ends are
   still in different components; components come from alternating large-star and small-star;
4. a member that is in the end not in the component of its bucket's smallest id is compared with the
   members of other components as in 2.

So no link that a bucket shows is lost, and no bucket is expanded into its pairs: a tile gives its near members, then a
spanning forest of its links, and never more rows than it has members. Two members are compared in one
of their buckets only. The chance that a pair
at the threshold shares no bucket is below 1e-5 with 32 bands of 4 minima, and 1e-6 that its signature fails.

Shingles are compared as 64-bit hashes. Documents without words have an empty set and are linked with
nothing; null texts are empty. Rows without an id are linked with nothing, have a null component and
are kept. Rows that share an id are one document; each gets a result row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import ship, sized_chunks, skew_safe_join, tidy
from cohortspark.session import stage

WORDS = 5
SHARE = 75  # per cent of the union
BANDS, ROWS = 32, 4
MINIMA = 256  # the first BANDS * ROWS make the bands, all make the signature
TILE = 512  # members of a bucket in a tile
CHUNK = 3_000_000  # characters worked on at once

_rng = np.random.default_rng(20240229)
FACTOR = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFT = _rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
ORDER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = lists.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique))
    w = hashes[coded.indices.to_numpy()] if len(unique) else hashes
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    empty = unique.index("") if "" in unique else -1
    rolled = np.zeros(max(len(w) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * ORDER + w[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    indices = coded.indices.to_numpy()
    for start, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        if end - start >= words:
            out.append(np.unique(rolled[start : end - words + 1]))
        elif end - start == 0 or end - start == 1 and indices[start] == empty:
            out.append(np.empty(0, np.uint64))
        else:  # too few words: the whole sequence, told apart from full shingles by its length
            whole = end - start
            for x in w[start:end].tolist():
                whole = (whole * int(ORDER) + x + 1) % 2**64
            out.append(mix(np.array([whole], np.uint64)))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every universal hash function over the set."""
    low = np.full(len(FACTOR), 2**32 - 1, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(folded), 2048):
        part = FACTOR[:, None] * folded[None, i : i + 2048]
        part += SHIFT[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key per row of minima and band; keys of different bands differ."""
    parts = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * ORDER + parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_shingles, f1 and f2 (hash of the set), sig (a byte per minimum), bands (keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
            for a, b in sized_chunks([range(n) for n in sizes], CHUNK):
                sets = shingle_sets(batch.column("text").slice(a, b - a))
                low = np.stack([minima(s) for s in sets])
                marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
                keys = band_keys(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                        pa.array([r.tobytes() for r in low.astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "sig", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, sig binary, bands array<bigint>")


def sig_floor(share: int) -> int:
    """Equal signature bytes that a pair at the threshold has but once in a million: five deviations below its mean."""
    n, p = MINIMA, share / 100
    return int(n * p - 5 * np.sqrt(n * p * (1 - p)))


def near_by_signature(pairs: DataFrame, reps: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow and whose signatures suggest the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            near = (one == two).sum(axis=1) >= floor
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    floor = sig_floor(share)
    own = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    other = reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = pairs.join(own, "a").join(other, "b")
    sized = both.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * share))
    kind = reps.schema["doc_id"].dataType.simpleString()
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), f"a {kind}, b {kind}")


def tiles(members: DataFrame, carried: DataFrame) -> DataFrame:
    """Members of buckets with the columns of ``carried`` (by doc_id), copied to tiles (key, x, y) of asking and of all members.

    ``members``: key, doc_id, n (members of the bucket), n_asks (those that ask), asks, group (null: a group of its own).
    """
    x, y = (F.ceil(F.col(c) / TILE).cast("int") for c in ("n_asks", "n"))
    own = lambda tiles: F.pmod(F.xxhash64("doc_id"), tiles).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), tiles - 1))
    full = members.join(carried, "doc_id").withColumn("group", F.coalesce("group", "doc_id"))
    columns = ["doc_id", "group", *[c for c in carried.columns if c != "doc_id"]]
    right = full.select("key", own(y).alias("y"), every(x).alias("x"), *columns, F.lit(False).alias("left"), F.lit(True).alias("right"))
    left = full.where("asks").select("key", every(y).alias("y"), own(x).alias("x"), *columns, F.lit(True).alias("left"), F.lit(False).alias("right"))
    return right.unionByName(left)


def near_in_buckets(members: DataFrame, reps: DataFrame, share: int) -> DataFrame:
    """Members (key, doc_id, asks) of buckets whose signatures are near to that of a member that asks, or that ask and have such a one.

    ``members`` as in ``tiles``; members of one ``group`` are not compared. Two members with several buckets in
    common count in the one of their first equal band. A tile gives no more rows than it has members.
    """
    id_type = reps.schema["doc_id"].dataType.simpleString()
    floor = sig_floor(share)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        size = table.column("n_shingles").to_numpy()
        group = table.column("group").to_numpy()
        asks, answers = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        key = table.column("key")[0].as_py()
        right = np.flatnonzero(answers)
        right = right[np.argsort(size[right], kind="stable")]
        seen = np.zeros(len(ids), bool)
        for i in np.flatnonzero(asks).tolist():
            lo = np.searchsorted(size[right], -(-size[i] * share // 100), "left")
            hi = np.searchsorted(size[right], size[i] * 100 // share, "right")
            near = right[lo:hi]
            near = near[(group[near] != group[i]) & (ids[near] != ids[i])]
            near = near[(sig[near] == sig[i]).sum(axis=1) >= floor]
            near = near[bands[near, (bands[near] == bands[i]).argmax(axis=1)] == key]
            seen[near] = True
            seen[i] = len(near) > 0
        out = table.select(["key", "doc_id", "left"]).filter(pa.array(seen))
        return out.rename_columns(["key", "doc_id", "asks"])

    dealt = tiles(members, reps.select("doc_id", "sig", "bands", "n_shingles"))
    return dealt.groupBy("key", "x", "y").applyInArrow(run, f"key bigint, doc_id {id_type}, asks boolean").distinct()


def links_in_buckets(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between members of buckets, a from those that ask, confirmed on the full ``sets`` (doc_id, set).

    ``members`` as in ``tiles``. A tile gives a spanning forest of its links, so fewer rows than it has members.
    """
    id_type = sets.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ids, group = table.column("doc_id").to_numpy(), table.column("group").to_numpy()
        asks, answers = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        size = np.array([len(x) for x in own])
        values = np.concatenate([own[j] for j in answers]) if len(answers) else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(answers)), size[answers])[order]
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for i in asks.tolist():
            lo, hi = np.searchsorted(values, own[i], "left"), np.searchsorted(values, own[i], "right")
            reach = hi - lo
            at = np.arange(reach.sum()) + np.repeat(lo - np.cumsum(reach) + reach, reach)
            both = np.bincount(owner[at], minlength=len(answers))
            linked = np.flatnonzero(100 * both >= share * (size[i] + size[answers] - both))
            for j in answers[linked].tolist():
                x, y = root(group[i]), root(group[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(max(ids[i], ids[j]))
                    b.append(min(ids[i], ids[j]))
        kind = table.schema.field("doc_id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    dealt = tiles(members, sets)
    return dealt.groupBy("key", "x", "y").applyInArrow(run, f"a {id_type}, b {id_type}").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (a, b) with the smallest node they reach, by alternating large-star and small-star: doc_id, component."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Per node u, its neighbours (the larger or the smaller ones) and the smallest of it and them become edges.

        A hot node's rows are split by the engine's skew join, as what follows shuffles anew.
        """
        near = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return stage(out.where("a <> b").distinct(), "edges")

    def settled(pairs: DataFrame) -> bool:
        """Whether every node has one edge at most, to a node that has none."""
        ends = pairs.select(F.col("a").alias("u"), F.lit(1).alias("own"), F.lit(0).alias("root")).unionByName(
            pairs.select(F.col("b").alias("u"), F.lit(0).alias("own"), F.lit(1).alias("root"))
        )
        bad = ends.groupBy("u").agg(F.sum("own").alias("own"), F.max("root").alias("root")).where("own > 1 OR (own = 1 AND root = 1)")
        return bad.limit(1).isEmpty()

    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not settled(now):
        now = star(star(now, large=True), large=False)
    return now.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))


def grown(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after the staged ``links`` (a, b) were found between them."""
    if links.limit(1).isEmpty():
        return comps
    return components(comps.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionByName(links))


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("doc_id").alias(end), F.col("component").alias("c" + end)), end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (whether that is its own)."""
    ship(docs.sparkSession)
    rows = stage(signatures(docs, id_col, text_col), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    reps = stage(
        full.join(classes.select("f1", "f2", F.col("rep").alias("doc_id")), ["doc_id", "f1", "f2"], "left_semi")
        .drop("f1", "f2"), "representatives",
    )
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = stage(banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stage(skew_safe_join(banded, buckets, ["key"], "n"), "members")
    starred = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    near_hub = stage(near_by_signature(starred, reps, share), "near-hub")
    far = members.where("doc_id <> hub").join(near_hub.toDF("doc_id", "hub"), ["doc_id", "hub"], "left_anti")
    found = _asked(members, far, None, reps, share)
    needed = near_hub.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(found.select("doc_id")).distinct()
    sets = stage(full_sets(docs, needed, id_col, text_col), "sets")
    first = near_hub.groupBy("a").agg(F.min("b").alias("b"))
    start = confirmed(first, sets, share).unionByName(_linked(found, None, sets, share))
    comps = components(start)
    comps = grown(comps, stage(confirmed(apart(near_hub, comps), sets, share), "links"))
    # members that are after all in another component than the smallest id of their bucket
    placed = members.join(comps, "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id")).drop("component")
    hubs = buckets.select("key", "hub").join(comps.toDF("hub", "component"), "hub", "left").select("key", F.coalesce("component", "hub").alias("hub_group"))
    left = placed.join(near_hub.toDF("doc_id", "hub"), ["doc_id", "hub"], "left_semi").join(hubs, "key").where("group <> hub_group")
    late = _asked(members, left.select("key", "doc_id", "n"), comps, reps, share)
    if late.take(1):
        more = late.select("doc_id").distinct().join(sets, "doc_id", "left_anti")
        sets = sets.unionByName(stage(full_sets(docs, more, id_col, text_col), "more-sets"))
        comps = grown(comps, _linked(late, comps, sets, share))
    placed = stage(
        classes.join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id")),
        "placed",
    )
    linked = skew_safe_join(full.select("doc_id", "n_shingles", "f1", "f2"), placed, ["f1", "f2"], "n").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept)


def _asked(members: DataFrame, asking: DataFrame, comps: DataFrame | None, reps: DataFrame, share: int) -> DataFrame:
    """The members ``asking`` (key, doc_id) and others of their buckets, as far as their signatures are near: staged, as ``tiles`` wants them."""
    asking = stage(asking.select("key", "doc_id", "n").distinct(), "asking")
    keys = asking.groupBy("key").agg(F.count(F.lit(1)).alias("n_asks"), F.max("n").alias("n"))
    own = members.select("key", "doc_id").join(keys, "key")
    own = own.join(asking.select("key", "doc_id", F.lit(True).alias("asks")), ["key", "doc_id"], "left")
    own = _grouped(own.withColumn("asks", F.coalesce("asks", F.lit(False))), comps)
    near = near_in_buckets(own, reps, share).groupBy("key", "doc_id").agg(F.max("asks").alias("asks"))
    return stage(near, "near-members")


def _grouped(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("group", F.col("doc_id"))
    return members.join(comps.withColumnRenamed("component", "group"), "doc_id", "left")


def _linked(near: DataFrame, comps: DataFrame | None, sets: DataFrame, share: int) -> DataFrame:
    """Links among the members that ``_asked`` gave."""
    keys = near.groupBy("key").agg(F.sum(F.col("asks").cast("bigint")).alias("n_asks"), F.count(F.lit(1)).alias("n"))
    return stage(links_in_buckets(_grouped(near.join(keys, "key"), comps), sets, share), "links")


def full_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sets of the documents in ``needed`` (doc_id): doc_id, set (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
            for a, b in sized_chunks([range(n) for n in sizes], CHUNK):
                sets = shingle_sets(batch.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.join(needed, "doc_id", "left_semi").mapInArrow(tidy(run), f"doc_id {kind}, set binary")
