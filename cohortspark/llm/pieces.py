"""Operator 3: SentencePiece encoding by backtracking, and decoding.

A text is normalised by the model, cut where no piece can reach across, and every cut is encoded
exactly as repeated merging of the best pair would: Aho-Corasick finds the longest piece at every
position; pieces are taken longest first; a piece may follow another one only if merging the two
again, from characters, gives the two back; positions from which no way leads on are marked in a
bit field and never tried again. The encoding of a prefix is unique, so a mark holds for good.

Null and empty texts give the begin and end ids alone and decode to the empty text. Repeated rows
and null ids give one result row each; columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from cohortspark.llm.common import WordIds, ship, sized_chunks, strings, tidy

SPACE = "▁"


class PieceEncoder:
    """Merge-type (BPE) encoding with the vocabulary of a SentencePiece model."""

    def __init__(self, model: str, most_pairs: int = 250_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        m = self.model
        self.score: dict[str, float] = {}
        ids: dict[str, int] = {}
        for i in range(m.get_piece_size()):
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                piece = m.id_to_piece(i)
                ids[piece], self.score[piece] = i, m.get_score(i)
        # a piece that merging does not rebuild from its characters never occurs in an encoding
        self.ids = {p: i for p, i in ids.items() if self.merge(list(p)) == [p]}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = m.is_byte(self.bytes[0])
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.most = max(map(len, self.ids))
        self.prefix: dict[str, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.most_pairs = most_pairs
        # words can be cut apart if space signs only ever lead a piece and a text starts with one
        self.by_words = m.normalize("a") == SPACE + "a" and not any(
            SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score
        )
        self.words = WordIds(self.words_ids)

    def merge(self, parts: list[str]) -> list[str]:
        """Merge the pair of best score, leftmost first, until none is a piece."""
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether ``b`` may stand right after ``a``: merging both again changes neither."""
        fit = self.fits.get((a, b))
        if fit is None:
            if len(self.fits) >= self.most_pairs:
                self.fits.clear()
            fit = self.fits[a, b] = self.merge([*a, *b]) == [a, b]
        return fit

    def shorter(self, piece: str) -> int:
        """Length of the next shorter piece that starts like ``piece``, 0 if there is none."""
        n = self.prefix.get(piece)
        if n is None:
            n = len(piece) - 1
            while n and piece[:n] not in self.ids:
                n -= 1
            self.prefix[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """The encoding of ``text``; a character outside the vocabulary is a piece of its own."""
        n, fits, follows, search = len(text), self.fits, self.follows, self.automaton.iter_long
        out: list[str] = []
        at, last = 0, ""
        for end, size in search(text):  # the longest piece at every step, as long as each may follow
            if end - size + 1 != at:
                break
            piece = text[at : end + 1]
            if last and not (fits.get((last, piece)) or follows(last, piece)):
                break
            out.append(piece)
            at, last = end + 1, piece
        if at == n:
            return out

        def longest(at: int) -> int:
            found = next(search(text[at : at + self.most]), None)
            return found[1] if found and found[0] == found[1] - 1 else 1

        failed = bytearray((n >> 3) + 1)
        size = longest(at)
        while at < n:
            while size:
                end = at + size
                piece = text[at:end]
                if not failed[end >> 3] >> (end & 7) & 1 and (
                    not out or fits.get((out[-1], piece)) or follows(out[-1], piece)
                ):
                    out.append(piece)
                    at, size = end, longest(end)
                    break
                size = self.shorter(piece)
            else:  # no piece leads on from here: mark the place and step back
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                size = self.shorter(piece)
        return out

    def word_ids(self, text: str) -> list[int]:
        text = text if not self.by_words or text.startswith("\n") else SPACE + text
        if text in self.ids:
            return [self.ids[text]]
        return self.segment_ids(text)

    def segment_ids(self, text: str) -> list[int]:
        out = []
        for piece in self.pieces(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.model.unk_id())
        return out

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = list(map(self.word_ids, words))
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.uint32, len(lists))

    def split(self, texts: list[str]) -> pa.ListArray:
        """Parts for ``word_ids``: words without their space sign, or a line break and what follows it."""
        texts = list(map(self.model.normalize, texts))
        if not self.by_words:
            return pa.array([[t] if t else [] for t in texts], pa.list_(pa.string()))
        if any(SPACE + SPACE in t or SPACE + "\n" in t for t in texts):  # space signs that no word follows
            parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
            return pa.array([[p[1:] if p[0] == SPACE else p for p in parts.findall(t)] for t in texts], pa.list_(pa.string()))
        lines = pc.replace_substring(pa.array(texts, pa.string()), "\n", SPACE + "\n")
        return pc.list_slice(pc.split_pattern(lines, SPACE), 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, without begin and end ids."""
        odd = [i for i, t in enumerate(texts) if "  " in t or " \n" in t or SPACE in t]
        if not odd or len(odd) == len(texts):
            return self.words.ids_of(self.split(texts))
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        out = self.words.ids_of(self.split(plain))
        for i, ids in zip(odd, self.words.ids_of(self.split([texts[i] for i in odd])), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(model: str) -> PieceEncoder:
    return PieceEncoder(model)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``ids``, the ids with begin and end ids as an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], ["doc_id", "ids"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Per row of ``encode``: ``doc_id`` and ``text``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder(model).model
        for batch in batches:
            texts = [m.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; encodes and decodes in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder(model).model
        for keys, lists in _encoded(batches, model):
            n, ids_sha, text_sha = [], [], []
            for ids in lists:
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(m.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    enc = encoder(model)
    first, last = (np.array([i], np.uint32) for i in (enc.model.bos_id(), enc.model.eos_id()))
    for batch in batches:
        texts = strings(batch, "text")
        for a, b in sized_chunks(texts):
            yield batch.column("doc_id").slice(a, b - a), [np.concatenate((first, x, last)) for x in enc.encode(texts[a:b])]
    enc.words.clear()
