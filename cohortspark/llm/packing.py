"""Operator 8: packing of tokenised documents into sequences, shortest pack first.

Documents are tokenised and cut into pieces of one sequence length and a rest. The rests are
packed over the histogram of their lengths alone: lengths are placed longest first, each into the
shortest open pack, where packs of one composition are one pattern with a count. Once as many
packs are open as all tokens need, a length that no pack can take is cut where the shortest pack
ends, and what is left goes back into the histogram. So every sequence but one is full.
Patterns are joined back to documents by rank: the rank of a rest among the rests of its length
tells its sequence. Ranks come from counts per input part, so no length gathers in one task.

What goes to the driver is one count per length; the list of runs it makes is bounded by the
sequence length, not by the data. Null and empty texts are the end id alone. Repeated rows are
packed each; columns other than the two named ones are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm.common import WordIds, ship, sized_chunks, strings, tidy
from cohortspark.session import stage


class WordTokenizer:
    """A tokenizers file whose pre-tokenizer drops white space, so that words are independent.

    ``independent`` is read from the file; with any other kind of file whole texts are encoded.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        first, kinds = steps[0], {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        self.independent = (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and kinds <= {"NFC", "Replace", "Lowercase"}
            and not any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        # the ids that end a word of letters, where the model marks them
        mark = spec["model"].get("end_of_word_suffix") or None
        self.letters = self.independent and mark is not None and "Lowercase" in kinds
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if mark and t.endswith(mark)]] = True
        self.words = WordIds(self.encode)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the number of ids of each.

        A word of Latin letters, without one dot or comma behind it, is one unit of the model:
        such words are encoded many at a time and cut at the ids that end a word.
        """
        cores = [w[:-1] if w[-1:] in (".", ",") else w for w in texts] if self.letters else []
        cores = [
            c.lower() if c.isalpha() and (c.isascii() or max(c) < "\u0250" and "\u0130" not in c) else None for c in cores
        ] or [None] * len(texts)
        unit = {c: i for i, c in enumerate({c for c in cores if c})}
        plain, parts = list(unit), []
        for i in range(0, len(plain), 200):
            parts.append(self.tokenizer.encode(" ".join(plain[i : i + 200]), add_special_tokens=False).ids)
        odd = [w for w, c in zip(texts, cores, strict=True) if not c] + [".", ","]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(parts + lists), np.uint32)
        n = sum(map(len, parts))
        ends = np.concatenate(([0], np.flatnonzero(self.last[flat[:n]]) + 1, n + np.cumsum([len(x) for x in lists])))
        if len(ends) != len(plain) + len(lists) + 1:
            raise ValueError("a word of letters is not one unit of this tokenizer")
        at, marks, rest = [], {".": len(ends) - 3, ",": len(ends) - 2}, iter(range(len(plain), len(ends) - 3))
        width = np.ones(len(texts), np.int64)
        for i, (w, c) in enumerate(zip(texts, cores, strict=True)):
            at.append(unit[c] if c else next(rest))
            if c and len(c) < len(w):
                at.append(marks[w[-1]])
                width[i] = 2
        at = np.array(at, np.int64)
        ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).take(pa.array(at)).flatten().to_numpy()
        total = np.concatenate(([0], np.cumsum(np.diff(ends)[at])))
        stops = np.cumsum(width)
        return ids, total[stops] - total[stops - width]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if not self.independent:
            return self.words.ids_of(pa.array([[t] if t else [] for t in texts], pa.list_(pa.string())))
        array = pa.array(texts, pa.string())
        if any(c in t for t in texts for c in "\x1c\x1d\x1e\x1f"):  # separators that the file does not see as white space
            return self.words.ids_of(pc.split_pattern_regex(array, r"[\s\p{Z}\x0b\x{85}]+"))
        return self.words.ids_of(pc.utf8_split_whitespace(array))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Pieces of at most ``size`` ids with their rank among the pieces of equal length of their input part.

    Columns doc_id, start, length, doc_tokens, crc (of a full piece, else null), ids (of a rest, little-endian
    unsigned 16 or 32 bit by ``wide``, else null), part, rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = strings(batch, "text")
            for a, b in sized_chunks(texts):
                rows: list[tuple] = []
                for i, ids in enumerate(tok.ids_of(texts[a:b])):
                    ids = np.concatenate((ids, end))
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        n = len(piece)
                        raw = None
                        if n < size:
                            wide = bool(piece.max() > 0xFFFF)
                            raw = bytes([wide]) + piece.astype("<u4" if wide else "<u2").tobytes()
                        rows.append((a + i, start, n, len(ids), crc(piece) if n == size else None, raw, part, int(seen[n])))
                        seen[n] += 1
                cols = list(zip(*rows, strict=True))
                arrays = [pc.take(batch.column("doc_id"), pa.array(cols[0], pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(cols[1:], [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "crc", "ids", "part", "rank"])
        tok.words.clear()

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, crc bigint, ids binary, part int, rank bigint"
    )


def shortest_pack_first(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs of equal placements for a histogram of lengths from 1 to ``size``.

    One row per run: length of the whole piece, first and last + 1 of its ranks, offset in the piece, length
    placed, first sequence, offset in the sequence. The pieces of a run go to consecutive sequences.
    """
    total = sum(n * c for n, c in counts.items())
    allowed, opened = -(-total // size), 0
    # waiting[length]: (whole length, first rank, offset in the piece, count)
    waiting: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, 0, c)] for n, c in counts.items() if c}
    todo = [-n for n in waiting]
    heapq.heapify(todo)
    packs: list[tuple[int, int, int]] = []  # (-free, first sequence, count): the shortest pack is on top
    runs = []
    while todo:
        n = -heapq.heappop(todo)
        for whole, rank, at, count in waiting.pop(n, []):
            while count:
                free = -packs[0][0] if packs else 0
                if free < n and opened < allowed:
                    fresh = min(count, allowed - opened)
                    heapq.heappush(packs, (-size, opened, fresh))
                    opened += fresh
                    free = size
                _, first, k = heapq.heappop(packs)
                used, placed = min(k, count), min(n, free)
                runs.append((whole, rank, rank + used, at, placed, first, size - free))
                if used < k:
                    heapq.heappush(packs, (-free, first + used, k - used))
                if placed < free:
                    heapq.heappush(packs, (placed - free, first, used))
                if placed < n:  # cut: the rest waits as a shorter length
                    if n - placed not in waiting:
                        waiting[n - placed] = []
                        heapq.heappush(todo, placed - n)
                    waiting[n - placed].append((whole, rank, at + placed, used))
                rank, count = rank + used, count - used
    return np.array(sorted(runs), np.int64).reshape(-1, 7)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stage(cut_pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    runs = shortest_pack_first({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    starts = np.searchsorted(runs[:, 0], np.arange(size + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], []
            start, length, crcs, raws, ranks = (batch.column(c).to_pylist() for c in ("start", "length", "crc", "ids", "rank"))
            for i, (s, n, whole_crc, raw, rank) in enumerate(zip(start, length, crcs, raws, ranks, strict=True)):
                own = runs[starts[n] : starts[n + 1]]
                own = own[(own[:, 1] <= rank) & (rank < own[:, 2])]
                ids = None if raw is None else np.frombuffer(raw, "<u4" if raw[0] else "<u2", offset=1)
                for _, first, _, at, placed, sequence, offset in own.tolist():
                    value = whole_crc if ids is None else crc(ids[at : at + placed])
                    take.append(i)
                    out.append((s + at, placed, value, sequence + rank - first, offset))
            cols = list(zip(*out, strict=True)) or [()] * 5
            index = pa.array(take, pa.int64())
            arrays = [pc.take(batch.column("doc_id"), index), pc.take(batch.column("doc_tokens"), index)]
            arrays += [pa.array(c, pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(
        tidy(place),
        f"doc_id {kind}, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
