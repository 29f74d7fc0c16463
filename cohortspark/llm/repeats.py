"""Operator 11: removal of repeated byte strings by external suffix sorting.

A byte goes if a string of ``window`` bytes that covers it starts at another place too, in the same document or another one.

1. Every window has an anchor, the least hash of the strings of ``gram`` bytes in it. Equal windows have equal anchors,
   so a text falls into runs of windows of one anchor, and only anchors of several runs or of a run that may repeat itself matter.
2. Equal runs are counted once, with their number as weight, before any text moves. What is left are distinct
   pieces of text, dealt to shards by anchor.
3. A shard writes its pieces as one text and sorts its suffixes externally (``suffixes``). Windows that
   share ``window`` bytes are neighbours; those of total weight two or more are repeated.
4. The marks go back to all runs of the piece, and from there to their documents.

An anchor with more than ``most`` distinct pieces, as at the edge of a passage that very many documents quote, is
cut again with a longer gram, in the end as long as the window: pieces of one anchor then agree in ever more
bytes, so they either part or become equal. No shard gets more than that of an anchor, nothing is dropped, and no step
holds all places of an anchor: anchors and pieces are joined by the number of their rows, the hottest by broadcast.

Scratch files of a shard lie in its task's own temporary folder, as spills do, and go with the task; everything
that another task reads is a written table in the shared folder.

Null and empty texts have no bytes, shorter ones than a window keep all. Repeated rows are documents
of their own and repeat each other. An empty table gives no rows. Columns other than the two named ones are not read. A
document may be cut inside a character: what is kept are bytes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import suffixes
from cohortspark.llm.common import ship, skew_safe_join, tidy
from cohortspark.session import stage

WINDOW = 200
RUN = 1 << 10  # windows of a run; longer ones are cut
MOST = 4096  # distinct pieces of an anchor in a shard
SHARD_BYTES = 2_000_000
CHUNK = 1_500_000  # bytes worked on at once

_rng = np.random.default_rng(20240311)
CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of ``gram`` bytes, by doubling."""
    power, step, factor = CODE[data], 1, BASE
    out, size = np.zeros(len(data), np.uint64), 0
    while True:
        if gram & step:
            n = len(data) - size - step + 1
            out = out[:n] * np.uint64(factor) + power[size : size + n]
            size += step
        if size == gram:
            return mix(out)
        power = power[:-step] * np.uint64(factor) + power[step:]
        step, factor = step * 2, factor * factor % 2**64


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(parts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one anchor in each part: part, first window, windows, anchor, hash of the run's bytes, and
    whether the anchor still stands in a window after the one that starts with it, as it must where windows of a run are equal."""
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    part = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
    grams = gram_hashes(data, gram)
    anchor = window_least(grams, window - gram + 1)
    leads = np.concatenate(([0], np.cumsum(grams[: len(anchor)] == anchor)))
    whole = part[: len(anchor)] == part[window - 1 :]
    first = whole.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(whole & np.append(first[1:] | ~whole[1:], True)) + 1
    cuts = -(-(stops - starts) // RUN)
    at = np.repeat(starts, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    n = np.minimum(RUN, np.repeat(stops, cuts) - at)
    view, hashed = memoryview(raw), xxhash.xxh3_64_intdigest
    more = window - 1
    marks = np.fromiter((hashed(view[x : x + k + more]) for x, k in zip(at.tolist(), n.tolist(), strict=True)), np.uint64, len(at))
    of = part[at]
    loops = leads[at + n - 1] > leads[at]
    return of, at - (ends - np.diff(ends, prepend=0))[of], n, anchor[at].view(np.int64), marks.view(np.int64), loops


RUNS = "first array<bigint>, n array<bigint>, anchor array<bigint>, mark array<bigint>, loops array<boolean>"


def cut(texts: DataFrame, window: int, gram: int, chunk: int = CHUNK, keep_text: bool = True) -> DataFrame:
    """``texts`` (text, any other columns) with ord, a number of the row's own, and the runs as arrays first, n, anchor, mark, loops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("text")
            lo = 0
            while lo < len(column):
                # rows up to ``chunk`` bytes at once; a longer text in slices that overlap by a window less one byte
                found, hi, size, parts, places = [], lo, 0, [], []
                while hi < len(column) and (hi == lo or size < chunk):
                    text = column[hi].as_buffer()
                    text = text.to_pybytes() if text is not None else b""
                    for x in range(0, len(text) - window + 1, chunk):
                        parts.append(text[x : x + chunk + window - 1])
                        places.append((hi - lo, x))
                        size += len(parts[-1])
                        if size >= chunk:
                            found.append((places, runs_of(parts, window, gram)))
                            parts, places, size = [], [], 0 if hi == lo else chunk
                    hi += 1
                if parts:
                    found.append((places, runs_of(parts, window, gram)))
                rows = [np.empty(0, np.int64)] * 5 + [np.empty(0, bool)]
                if found:
                    columns = []
                    for where, (part, first, *rest) in found:
                        where = np.array(where)
                        columns.append([where[part, 0], where[part, 1] + first, *rest])
                    rows = [np.concatenate(c) for c in zip(*columns, strict=True)]
                offsets = pa.array(np.searchsorted(rows[0], np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in rows[1:]]
                own = batch.slice(lo, hi - lo).select(kept)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(number + np.arange(lo, hi)), *lists], [*kept, "ord", "first", "n", "anchor", "mark", "loops"]
                )
                lo = hi
            number += len(column)

    kept = [c for c in texts.columns if keep_text or c != "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.mapInArrow(tidy(run), f"{kinds}, ord bigint, {RUNS}")


def _again(anchor: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Places of pieces that came before."""
    order = np.lexsort((mark, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (mark[order][1:] == mark[order][:-1])
    return order[1:][same]


def shard_marks(pieces: DataFrame, window: int, rows_held: int, names_held: int) -> DataFrame:
    """Sort the pieces (anchor, mark, weight, n_rows, n, text) of each partition: anchor, mark, n_rows, and the repeated windows as from and to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            path, kept, sizes = os.path.join(folder, "text"), [], []
            shift = bytes(range(1, 256)) + b"\xff"  # no byte of UTF-8 is 255; 0 ends a piece
            with open(path, "wb") as f:
                for batch in batches:
                    kept.append(np.stack([batch.column(c).to_numpy() for c in ("anchor", "mark", "weight", "n_rows", "n")]))
                    for text in batch.column("text"):
                        f.write(text.as_buffer().to_pybytes().translate(shift) + b"\0")
                        sizes.append(len(text.as_buffer()) + 1)
                size = sum(sizes)
                f.write(suffixes.Text.pad(size, 1))
            if not size:
                return
            anchor, mark, weight, n_rows, n = np.concatenate(kept, axis=1)
            starts = np.cumsum(sizes) - sizes
            weight[_again(anchor, mark)] = 0  # equal rows of one document give a piece twice; its weight has both
            repeated = np.memmap(os.path.join(folder, "marks"), bool, "w+", shape=(size + 1,))
            # neighbours that share a window are one group; of its first member only the place is kept until a second comes
            weight_so_far, first_place = 0, -1
            for places, shared in suffixes.suffixes(suffixes.Text(path, size, 1), window, folder, rows_held, names_held):
                piece = np.searchsorted(starts, places, "right") - 1
                own = np.where(places - starts[piece] < n[piece], weight[piece], 0)
                group = np.cumsum(shared < window)
                total = np.bincount(group, own, group[-1] + 1)
                total[0] += weight_so_far
                repeated[places[(own > 0) & (total[group] > 1)]] = True
                if first_place >= 0 and total[0] > 1:
                    repeated[first_place] = True
                last = group == group[-1]
                if group[-1]:
                    first_place = -1
                held = places[last & (own > 0)]
                first_place = int(held[0]) if len(held) and first_place < 0 else first_place
                weight_so_far = total[-1]
            step = np.diff(np.concatenate(([0], repeated[:size].view(np.int8), [0])).astype(np.int8))
            from_, to = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            piece = np.searchsorted(starts, from_, "right") - 1
            some = np.unique(piece)
            offsets = pa.array(np.append(np.searchsorted(piece, some), len(piece)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x - starts[piece])) for x in (from_, to)]
            del repeated
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[some]), pa.array(mark[some]), pa.array(n_rows[some]), *lists], ["anchor", "mark", "n_rows", "from", "to"]
            )

    return pieces.mapInArrow(tidy(run), "anchor bigint, mark bigint, n_rows bigint, from array<bigint>, to array<bigint>")


def piece_texts(found: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted runs of texts (text, and a list own of anchor, mark, weight, n_rows, first, n), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "mark", "weight", "n_rows", "n"]
        for batch in batches:
            own = batch.column("own")
            of = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            flat = own.flatten()
            first, n = (flat.field(c).to_numpy() for c in ("first", "n"))
            for lo in range(0, len(flat), 8192):
                part = flat.slice(lo, 8192)
                texts, last, at = [], -1, b""
                for i in range(lo, lo + len(part)):
                    if of[i] != last:
                        last, at = of[i], memoryview(batch.column("text")[int(of[i])].as_buffer())
                    texts.append(bytes(at[first[i] : first[i] + n[i] + window - 1]))
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in names), pa.array(texts, pa.binary())], [*names, "text"])

    return found.select("text", "own").mapInArrow(tidy(run), "anchor bigint, mark bigint, weight bigint, n_rows bigint, n bigint, text binary")


def repeated_windows(
    rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], window: int, grams: list[int], most: int = MOST, shard_bytes: int = SHARD_BYTES,
    rows_held: int = suffixes.ROWS_HELD, names_held: int = suffixes.NAMES_HELD, chunk: int = CHUNK,
) -> DataFrame:
    """Per ord the repeated windows of its text as spans (from, to).

    ``rows`` are staged runs as ``cut`` gives them, with a weight; ``fetch`` adds to rows with ord the column text.
    """
    zipped = F.explode(F.arrays_zip("first", "n", "anchor", "mark", "loops")).alias("r")
    runs = rows.select("ord", "weight", zipped).select("ord", "weight", "r.*")
    counts = runs.groupBy("anchor").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_runs"), F.max("loops").alias("loops"))
    anchors = stage(counts.where("total > 1 OR loops").select("anchor", "n_runs"), "anchors")
    mine = stage(skew_safe_join(runs.drop("loops"), anchors, ["anchor"], "n_runs").drop("n_runs"), "candidate-runs")
    place = F.col("ord").cast("decimal(20,0)") * F.lit(2**42).cast("decimal(13,0)") + (F.col("first") * 2**11 + F.col("n"))
    pieces = stage(
        mine.groupBy("anchor", "mark").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_rows"), F.min(place).alias("place")).select(
            "anchor", "mark", "weight", "n_rows", F.expr(f"place div {2**42}").alias("ord"), F.expr(f"CAST(place % {2**42} AS BIGINT)").alias("rest")
        ).select("*", F.expr(f"rest div {2**11}").alias("first"), F.expr(f"rest % {2**11}").alias("n")).drop("rest"),
        "pieces",
    )
    wide = None
    if len(grams) > 1:
        many = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_pieces")).where(F.col("n_pieces") > most)
        wide = stage(many, "wide-anchors")
        wide = wide if wide.take(1) else None

    def texts_of(part: DataFrame) -> DataFrame:
        own = F.collect_list(F.struct("anchor", "mark", "weight", "n_rows", "first", "n")).alias("own")
        return piece_texts(fetch(part.groupBy("ord").agg(own)), window)

    narrow = pieces
    if wide is not None:
        split = stage(skew_safe_join(pieces, wide, ["anchor"], "n_pieces").drop("n_pieces"), "wide-pieces")
        narrow = stage(pieces.join(split.select("anchor", "mark"), ["anchor", "mark"], "left_anti"), "narrow-pieces")
    size = narrow.agg(F.sum(F.col("n") + window)).first()[0] or 0
    marks = shard_marks(texts_of(narrow).repartition(max(1, -(-size // shard_bytes)), "anchor"), window, rows_held, names_held)
    if wide is not None:
        inner = texts_of(split).select("text", "weight", "n_rows", F.col("anchor").alias("outer_anchor"), F.col("mark").alias("outer_mark"))
        inner = stage(cut(inner, window, grams[1], chunk), "wide-runs")
        spans = repeated_windows(
            inner, lambda wanted: inner.select("ord", "text").join(wanted, "ord"), window, grams[1:], most, shard_bytes, rows_held, names_held, chunk
        )
        own = spans.groupBy("ord").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
        keyed = inner.select("ord", "n_rows", F.col("outer_anchor").alias("anchor"), F.col("outer_mark").alias("mark")).join(own, "ord")
        keyed = keyed.dropDuplicates(["anchor", "mark"])  # equal rows of one document may give a piece twice
        marks = marks.unionByName(keyed.select("anchor", "mark", "n_rows", F.col("spans.from").alias("from"), F.col("spans.to").alias("to")))
    marks = stage(marks, "marks")
    back = skew_safe_join(mine.select("ord", "first", "anchor", "mark"), marks, ["anchor", "mark"], "n_rows")
    spans = back.select("ord", "first", F.explode(F.arrays_zip("from", "to")).alias("s"))
    return spans.select("ord", (F.col("first") + F.col("s.from")).alias("from"), (F.col("first") + F.col("s.to")).alias("to"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other bytes)."""
    ship(docs.sparkSession)
    grams = sorted({max(1, window // 8), max(1, window - 16), window})
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))  # with its id it tells a document; rows equal in both share their spans
    rows = stage(cut(texts.withColumn("weight", F.lit(1).cast("bigint")), window, grams[0], limits.get("chunk", CHUNK), keep_text=False), "runs")
    ids = rows.select("ord", "doc_id", "h")

    def with_text(found: DataFrame, columns: list[str], how: str) -> DataFrame:
        """``texts`` joined with ``found`` (doc_id, h and ``columns``)."""
        found = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *columns)
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
        return texts.join(found, same, how).select("doc_id", "text", *columns)

    def fetch(wanted: DataFrame) -> DataFrame:
        keyed = stage(wanted.join(ids, "ord").select("doc_id", "h", "own"), "wanted")
        return with_text(keyed, ["own"], "inner")

    spans = repeated_windows(rows, fetch, window, grams, **limits)
    merged = spans.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("own"))
    # rows equal in id and text have equal spans
    own = merged.join(ids, "ord").select("doc_id", "h", "own").dropDuplicates(["doc_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, kept, sizes = [], [], [], []
            for text, own in zip(batch.column("text"), batch.column("own"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(data))
                if not own.is_valid:
                    removed.append(0)
                    n_spans.append(0)
                    kept.append(data)
                    continue
                from_, to = (own.values.field(c).to_numpy() for c in ("from", "to"))
                reach = np.maximum.accumulate(to + window - 1)
                new = np.flatnonzero(np.concatenate(([True], from_[1:] > reach[:-1])))
                starts, ends = from_[new], reach[np.append(new[1:], len(from_)) - 1]
                edges = np.concatenate(([0], ends)), np.append(starts, len(data))
                kept.append(b"".join(data[x:y] for x, y in zip(*(e.tolist() for e in edges), strict=True)))
                removed.append(int((ends - starts).sum()))
                n_spans.append(len(starts))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, n_spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_text(own, ["own"], "left").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
