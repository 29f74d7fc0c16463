"""Operator 12: alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Every text is encoded twice; where tokens of both end at the same byte, the text is cut into groups, and the
tokens of a group are linked each with each. Documents get a place in a segment (a bounded run of documents
of one task). Per segment and pair of ids there is one posting: a bitmap of documents for every bit of the
number of links (multiplicity planes), each kept as a sorted list of 16-bit places or as a bit set, whichever is
shorter. OR of the planes, popcounted, gives the documents that hold the pair, as segments share no document a sum
over segments gives the corpus count; planes popcounted with their weights give links. The counts go back along the postings: a
document's score is the sum over planes of weight times count where its bit is set.

Links are counted, never listed: a large group is reduced to its distinct ids with their numbers first. No
step gathers more than one segment or one pair's counts, and a pair has at most one row per segment, so no key
is hot. The only broadcast has one row per id of the first vocabulary.

Null, empty and not faithfully encoded texts (the tokens' bytes are not those of the text behind a space) have no
tokens: all numbers are zero and the groups are empty. Repeated rows and null ids are documents of their own. An empty table
gives no rows. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortspark.llm.common import ship, sized_chunks, strings, tidy
from cohortspark.session import stage

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # how byte-level BPE splits text first
SPACE = "▁"
CHUNK = 1_500_000  # characters worked on at once
SEGMENT_DOCS = 1 << 16  # places are 16-bit numbers
SEGMENT_POSTINGS = 2_000_000  # (pair, document) entries after which a segment ends
WIDE = 64  # links in a group above which its ids are counted first
LINKS = 4_000_000  # links made at once


def byte_chars() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Bytes, lengths and printed ids of a vocabulary, for whole arrays of ids."""

    def __init__(self, pieces: list[bytes], end: str):
        self.pieces = pa.array(pieces, pa.large_binary())
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.printed = [f"{i}{mark}" for i in range(len(pieces)) for mark in (",", end)]

    def faithful(self, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Per text, whether its tokens' bytes are the text's."""
        data = memoryview(self.pieces.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        at = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return np.array([data[x:y] == t for x, y, t in zip(at[:-1], at[1:], texts, strict=True)], bool)


class Pair:
    """Two tokenizers: byte-level BPE from a JSON file, pieces from a SentencePiece model."""

    def __init__(self, byte_bpe: str, piece_model: str):
        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        back = byte_chars()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.a_encoder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces_a = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces_a[i] = piece
        m = self.b_encoder = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces_b = [
            bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(m.get_piece_size())
        ]
        self.a, self.b = Tokens(pieces_a, "|"), Tokens(pieces_b, ";")
        self.n_b = len(pieces_b)
        if len(pieces_a) * self.n_b >= 1 << 32:
            raise ValueError("the product of both vocabularies must stay below 2**32")
        self.printed = pa.array(self.a.printed + self.b.printed, pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a_encoder.encode_ordinary(" " + t) for t in texts], self.b_encoder.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def pair(byte_bpe: str, piece_model: str) -> Pair:
    return Pair(byte_bpe, piece_model)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the number (or the summed weights) of each."""
    order = None if weights is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def products(ga, ids_a, n_a, gb, ids_b, n_b, slot_of, width):
    """Keys (pair, place) and numbers of links of groups, both sides sorted by group; at most ``LINKS`` (or one token's) at once."""
    groups = int(max(ga[-1], gb[-1])) + 1 if len(ga) else 0
    start = np.searchsorted(gb, np.arange(groups + 1))
    reach = np.diff(start)[ga] if groups else np.empty(0, np.int64)
    total = np.concatenate(([0], np.cumsum(reach)))
    lo = 0
    while lo < len(ga):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + LINKS, "right")) - 1)
        r = reach[lo:hi]
        other = np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], r) + np.repeat(start[ga[lo:hi]], r)
        own = np.repeat(np.arange(lo, hi), r)
        key = (ids_a[own].astype(np.uint64) * np.uint64(width) + ids_b[other].astype(np.uint64)) << np.uint64(32) | slot_of[ga[own]].astype(np.uint64)
        weights = None if n_a is None else n_a[own] * n_b[other]
        yield counted(key, weights)
        lo = hi


class Aligned:
    """The alignment of a list of texts: numbers per text, and (pair, place) keys with their numbers of links."""

    def __init__(self, both: Pair, texts: list[str], first_place: int):
        raw = [b" " + t.encode() if t else b"" for t in texts]
        full = [i for i, t in enumerate(texts) if t]
        ids, counts = [], []
        for lists in both.encode([texts[i] for i in full]):
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(counts[-1].sum())))
        good = np.ones(len(full), bool)
        for side, i, n in zip((both.a, both.b), ids, counts, strict=True):
            good &= side.faithful(i, n, [raw[j] for j in full])
        docs = np.array(full, np.int64)[good]
        a, b = (i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True))
        per_a, per_b = (n[good] for n in counts)
        end_a, end_b = np.cumsum(both.a.sizes[a]), np.cumsum(both.b.sizes[b])
        size = int(end_a[-1]) + 1 if len(a) else 1
        marks = np.zeros((2, size), bool)
        marks[0, end_a] = marks[1, end_b] = True
        cut_a, cut_b = marks[1, end_a], marks[0, end_b]
        ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_groups = int(cut_a.sum())
        na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        doc_of = np.repeat(docs, per_a)[cut_a]
        rows = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(rows, np.int64) for _ in range(4))
        self.n_a[docs], self.n_b[docs] = per_a, per_b
        np.add.at(self.n_groups, doc_of, 1)
        np.add.at(self.n_links, doc_of, na * nb)
        # the printed groups: tokens of A, then of B, group after group
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate(([0], np.cumsum(nb)))[ga]] = a * 2 + cut_a
        codes[np.arange(len(b)) + np.cumsum(na)[gb] if len(b) else slice(0, 0)] = len(both.a.printed) + b * 2 + cut_b
        printed = both.printed.take(pa.array(codes))
        at = np.frombuffer(printed.buffers()[1], np.int64)[np.concatenate(([0], np.cumsum(per_a + per_b)))].tolist() if len(codes) else []
        data = memoryview(printed.buffers()[2] or b"").cast("B")
        self.groups = [b""] * rows
        for doc, x, y in zip(docs.tolist(), at[:-1], at[1:], strict=False):
            self.groups[doc] = data[x : y - 1]
        wide = na * nb > WIDE
        places = doc_of + first_place
        self.keys, self.links = [], []
        for few in (True, False):
            x, y = wide[ga] != few, wide[gb] != few
            one, two = (ga[x], a[x], None), (gb[y], b[y], None)
            if not few:
                one, two = (self._distinct(*side[:2]) for side in (one, two))
            for key, n in products(*one, *two, places, both.n_b):
                self.keys.append(key)
                self.links.append(n)

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = counted(group << 32 | ids)
        return key >> 32, key & 0xFFFFFFFF, n


def planes_of(keys: np.ndarray, links: np.ndarray, width: int) -> dict[str, pa.Array | np.ndarray]:
    """Postings of a segment from distinct sorted (pair, place) keys: ids, documents, links, and planes.

    ``kinds`` has for each plane twice the bit's number, plus one if ``bits`` is a bit set and not a list of places.
    """
    pairs, place = keys >> np.uint64(32), (keys & np.uint64(0xFFFF)).astype("<u2")
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    row = np.cumsum(np.concatenate(([False], pairs[1:] != pairs[:-1])))
    bits_of, rows_of, plane_of = [], [], []
    for plane in range(int(links.max()).bit_length()):
        has = (links >> plane & 1).astype(bool)
        r = row[has]
        if len(r):
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            slots = place[has]
            ends = np.append(cuts[1:], len(r))
            parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(r)).astype(np.int64) * 2), pa.py_buffer(slots)])
            dense = np.flatnonzero((ends - cuts) * 2 > (slots[ends - 1] >> 3) + 1)
            if len(dense):
                sets = []
                for x, y in zip(cuts[dense].tolist(), ends[dense].tolist(), strict=True):
                    flags = np.zeros(int(slots[y - 1]) + 1, np.uint8)
                    flags[slots[x:y]] = 1
                    sets.append(np.packbits(flags, bitorder="little").tobytes())
                pick = np.arange(len(cuts))
                pick[dense] = len(cuts) + np.arange(len(dense))
                parts = pa.concat_arrays([parts, pa.array(sets, pa.large_binary())]).take(pa.array(pick))
            kind = np.full(len(cuts), plane * 2)
            kind[dense] += 1
            bits_of.append(parts)
            rows_of.append(r[cuts])
            plane_of.append(kind)
    rows, kinds = np.concatenate(rows_of), np.concatenate(plane_of)
    order = np.argsort(rows, kind="stable")
    offsets = pa.array(np.searchsorted(rows[order], np.arange(len(first) + 1)).astype(np.int32))
    bits = pa.concat_arrays(bits_of).take(pa.array(order)).cast(pa.binary())
    head = pairs[first].astype(np.int64)
    return {
        "a": pa.array((head // width).astype(np.int32)), "b": pa.array((head % width).astype(np.int32)),
        "docs": pa.array(np.diff(first, append=len(keys)).astype(np.int64)),  # popcount of the OR of the planes: every place has a link
        "links": pa.array(np.add.reduceat(links, first)),
        "kinds": pa.ListArray.from_arrays(offsets, pa.array(kinds[order].astype(np.int32))), "bits": pa.ListArray.from_arrays(offsets, bits),
    }


def opened(kinds: pa.ListArray, bits: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of every set bit of the planes."""
    row = np.repeat(np.arange(len(kinds)), np.diff(kinds.offsets.to_numpy()))
    kind, flat = kinds.flatten().to_numpy(), bits.flatten()
    sparse = kind % 2 == 0
    picked = flat.filter(pa.array(sparse))
    at = np.frombuffer(picked.buffers()[1], np.int32)[picked.offset : picked.offset + len(picked) + 1]
    slots = [np.frombuffer(memoryview(picked.buffers()[2] or b"")[int(at[0]) : int(at[-1])], "<u2")] if len(picked) else [np.empty(0, "<u2")]
    of = [np.repeat(np.flatnonzero(sparse), np.diff(at) // 2)] if len(picked) else [np.empty(0, np.int64)]
    for i in np.flatnonzero(~sparse).tolist():
        where = np.flatnonzero(np.unpackbits(np.frombuffer(flat[i].as_buffer(), np.uint8), bitorder="little"))
        slots.append(where)
        of.append(np.full(len(where), i))
    of = np.concatenate(of)
    return row[of], np.concatenate(slots).astype(np.int64), np.int64(1) << (kind[of] // 2).astype(np.int64)


POSTING = "a int, b int, docs bigint, links bigint, kinds array<int>, bits array<binary>"
NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def index(
    docs: DataFrame, byte_bpe: str, piece_model: str, printed: bool = False, most: int = SEGMENT_POSTINGS, chunk: int = CHUNK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The staged index: a row per document (slot is set) and a row per posting (a and b are set), by segment.

    With ``printed`` the documents' groups come as text too. A segment ends after ``most`` postings.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_bpe, piece_model)
        segment, places = TaskContext.get().partitionId() << 32, 0
        keys, links, held = [], [], 0

        def row_batch(n: int, values: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([values[f.name] if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.concatenate(keys), np.concatenate(links)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            twice = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            made = planes_of(key[twice], np.add.reduceat(n, twice), both.n_b)
            whole = row_batch(len(made["a"]), made | {"segment": pa.array(np.full(len(made["a"]), segment))})
            for i in range(0, len(whole), 20_000):
                yield whole.slice(i, 20_000)

        for batch in batches:
            texts = strings(batch, "text")
            for x, y in sized_chunks(texts, chunk):
                for lo in range(x, y, SEGMENT_DOCS):
                    hi = min(y, lo + SEGMENT_DOCS)
                    if places and (places + hi - lo > SEGMENT_DOCS or held > most):
                        if held:
                            yield from flush()
                        segment, places, keys, links, held = segment + 1, 0, [], [], 0
                    got = Aligned(both, texts[lo:hi], places)
                    keys += got.keys
                    links += got.links
                    held += sum(map(len, got.keys))
                    hashes = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in got.groups]
                    values = {
                        "segment": pa.array(np.full(hi - lo, segment)), "slot": pa.array(np.arange(places, places + hi - lo, dtype=np.int32)),
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo), "groups_sha256": pa.array(hashes, pa.string()),
                    } | {c: pa.array(getattr(got, c)) for c in ("n_a", "n_b", "n_groups", "n_links")}
                    if printed:
                        values["groups"] = pa.array([bytes(g).decode() for g in got.groups], pa.string())
                    yield row_batch(hi - lo, values)
                    places += hi - lo
        if held:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    names = f"segment bigint, slot int, doc_id {kind}, {NUMBERS}, groups_sha256 string, groups string, {POSTING}"
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = to_arrow_schema(StructType.fromDDL(names))
    return stage(rows.mapInArrow(tidy(run), names), "pair-index")


def pair_counts(indexed: DataFrame) -> DataFrame:
    """Per pair of ids: a, b, docs (documents that hold the pair linked), links."""
    return indexed.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))


def scores(indexed: DataFrame) -> DataFrame:
    """Per document: doc_id, its numbers, n_best and count_sum from the corpus counts, groups and their hash."""
    counts = stage(pair_counts(indexed).select("a", "b", F.col("docs").alias("count")), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # at most one row per id of the first vocabulary
    ranked = counts.join(F.broadcast(best), "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))
    postings = indexed.where("a IS NOT NULL").join(ranked, ["a", "b"]).select(F.col("segment").alias("of"), "count", "is_best", "kinds", "bits")
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    rows = indexed.where("slot IS NOT NULL").select(F.col("segment").alias("own"), "slot", *shown)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        slot = left.column("slot").to_numpy()
        best_of, sum_of = np.zeros((2, int(slot.max(initial=-1)) + 1), np.int64)
        if len(right) and len(slot):
            count, first = right.column("count").to_numpy(), right.column("is_best").to_numpy(zero_copy_only=False)
            row, place, weight = opened(right.column("kinds").chunk(0), right.column("bits").chunk(0))
            np.add.at(sum_of, place, weight * count[row])
            np.add.at(best_of, place, weight * first[row])
        out = left.select(shown)
        return out.append_column("n_best", pa.array(best_of[slot])).append_column("count_sum", pa.array(sum_of[slot]))

    kind = indexed.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {kind}, {NUMBERS}, groups_sha256 string, groups string, n_best bigint, count_sum bigint"
    return rows.groupBy("own").cogroup(postings.groupBy("of")).applyInArrow(run, names)


def align(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return scores(index(docs, byte_bpe, piece_model)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
