"""Operator 13: fill-in-middle transformation by displacement scatter, and back.

A text is cut into units, runs of ASCII letters or single other characters, and at two of its unit borders
into prefix, middle and suffix, which come out in another order behind marks. All texts of a batch are one
byte array. Every part of every text moves as a whole, so the change of displacement is written at the
part's first byte into a difference array; its running sum is the displacement of every byte, and one
scatter builds all outputs. The way back reads the marks from the outputs alone: differences at the parts'
places in the restored text, a running sum, and one gather.

Where to cut and how comes from hashes of the seed and the id, so results do not depend on partitions.
Texts that hold a mark stay plain: marks in an output are then exactly those written, as no proper overlap
of two marks exists. Null texts are empty and plain; a null id counts as the empty string in the draws. Rows that share
an id are cut by the same draws. An empty table gives no rows. Columns other than the two named ones are not read by
``transform`` and are kept by ``restore``, unless they are called like its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortspark.llm.common import ship, sized_chunks, strings, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
MARK = 3  # bytes of a mark
PLAIN, SPM, PSM = "plain", "spm", "psm"
PLAIN_FROM = 90  # of 100 texts those whose third draw is at least this stay plain
SPM_BELOW = 20  # of 100 others those whose fourth draw is less lead with the suffix
CHUNK = 2_000_000  # characters worked on at once


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers per id, from the SHA-256 of ``seed:id``."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and the place of each part's first byte and of the end."""
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def unit_starts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Places where a unit starts; no unit reaches over a border."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    inner = borders[:-1][np.diff(borders) > 0]
    starts[inner] = True
    return np.flatnonzero(starts)


def placed(first: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """The shift of every byte, from the first bytes of parts (in order, empty parts last of equals) and their shifts."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, first, np.diff(shift, prepend=0))
    return np.cumsum(change[:-1])


def scatter(texts: list[str], ids: list, seed: int, plain_from: int, spm_below: int) -> dict[str, list | np.ndarray]:
    """Outputs and cuts of a batch of texts."""
    data, at = joined([t.encode() for t in texts])
    starts = unit_starts(data, at)
    low = np.searchsorted(starts, at)  # units before each text
    units = np.diff(low)
    h = draws(ids, seed)
    a, b = (h[:, k] % (units + 1) for k in (0, 1))
    ends = np.append(starts, len(data))
    cut1, cut2 = (ends[low[:-1] + f(a, b)] for f in (np.minimum, np.maximum))
    # the border behind the last unit is the next text's first byte, also past empty texts
    cut1, cut2 = np.minimum(cut1, at[1:]), np.minimum(cut2, at[1:])
    plain = np.array([not t or any(m in t for m in MARKS) for t in texts], bool) | (h[:, 2] % 100 >= plain_from)
    spm = ~plain & (h[:, 3] % 100 < spm_below)
    p, m, s = cut1 - at[:-1], cut2 - cut1, at[1:] - cut2
    out_at = np.concatenate(([0], np.cumsum(np.where(plain, 0, 3 * MARK) + np.diff(at))))
    base = out_at[:-1]
    to_p = base + np.where(plain, 0, np.where(spm, 2 * MARK + s, MARK))
    to_m = np.where(plain, base + p, np.where(spm, to_p + p + MARK, base + 3 * MARK + p + s))
    to_s = np.where(plain, base + p + m, np.where(spm, base + MARK, base + 2 * MARK + p))
    first = np.stack([at[:-1], cut1, cut2], axis=1).ravel()
    shift = np.stack([to_p, to_m, to_s], axis=1).ravel() - first
    out = np.empty(out_at[-1], np.uint8)
    out[np.arange(len(data)) + placed(first, shift, len(data))] = data
    for mark, place in ((PREFIX, to_p), (MIDDLE, to_m), (SUFFIX, to_s)):
        where = place[~plain] - MARK
        for k, byte in enumerate(mark.encode()):
            out[where + k] = byte
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return {
        "n": units, "plain": plain, "form": np.where(plain, PLAIN, np.where(spm, SPM, PSM)),
        "prefix_chars": chars[cut1] - chars[at[:-1]], "middle_chars": chars[cut2] - chars[cut1],
        "output": [out[x:y].tobytes().decode() for x, y in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True)],
    }


def gather(outputs: list[str], forms: list[str | None]) -> list[str]:
    """The texts that ``outputs`` were made of; ``forms`` says which are plain."""
    data, at = joined([t.encode() for t in outputs])
    moved = np.array([f in (PSM, SPM) for f in forms], bool)
    place = {}
    for mark in MARKS:
        x, y, z = mark.encode()
        hits = np.flatnonzero((data[:-2] == x) & (data[1:-1] == y) & (data[2:] == z)) if len(data) > 2 else np.empty(0, np.int64)
        k = np.searchsorted(hits, at[:-1])
        found = np.append(hits, len(data))[k]
        if (moved & (found + MARK > at[1:])).any():
            raise ValueError(f"an output that is not plain lacks the mark {mark}")
        place[mark] = np.where(moved, found, at[:-1])
    p, s, m = (place[x] for x in MARKS)
    spm = s < p
    gap = np.where(moved, MARK, 0)
    n_p = np.where(moved, np.where(spm, m, s) - p - MARK, at[1:] - at[:-1])
    n_s = np.where(moved, np.where(spm, p, m) - s - MARK, 0)
    n_m = np.where(moved, at[1:] - m - MARK, 0)
    text_at = np.concatenate(([0], np.cumsum(n_p + n_m + n_s)))
    first = np.stack([text_at[:-1], text_at[:-1] + n_p, text_at[:-1] + n_p + n_m], axis=1).ravel()
    shift = np.stack([p + gap, m + gap, s + gap], axis=1).ravel() - first
    size = int(text_at[-1])
    back = data[np.arange(size) + placed(first, shift, size)]
    return [back[x:y].tobytes().decode() for x, y in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]


def transform(
    docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), strings(batch, "text")
            for a, b in sized_chunks(texts, CHUNK):
                got = scatter(texts[a:b], ids[a:b], seed, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array(got["n"], pa.int64()), pa.array(got["form"].tolist(), pa.string()),
                        pa.array(got["prefix_chars"], pa.int64(), mask=got["plain"]), pa.array(got["middle_chars"], pa.int64(), mask=got["plain"]),
                        pa.array(got["output"], pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with the column restored: the text, from output and form alone."""
    ship(rows.sparkSession)
    rows = rows.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = strings(batch, "output"), batch.column("form").to_pylist()
            for a, b in sized_chunks(outputs, CHUNK):
                back = pa.array(gather(outputs[a:b], forms[a:b]), pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, back], [*part.schema.names, "restored"])

    return rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, StructField("restored", StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, and the hashes of output and of the restored text."""
    sha = lambda c: F.sha2(F.col(c), 256).alias(c + "_sha256")
    return restore(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
