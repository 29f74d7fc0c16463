"""The alignment of two tokenizers against a plain count of all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cohortspark.llm import align

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "\n\n", "a", "tok  en\n\n x", "ÀÉ ñ 日本 \x00\x1c  <s> <|endoftext|> <0x0A>", "▁under", "é" * 9, "x" * 3001, "-=" * 500, "ab\u0085c　"]


def brute(texts):
    """Numbers per text, and documents and links per pair."""
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    back = align.byte_chars()
    rows, held, links = [], [], []
    for t in texts:
        want = b" " + (t or "").encode()
        a = a_of.encode(" " + (t or ""), add_special_tokens=False).ids
        b = b_of.encode(t or "")
        bytes_a = [bytes(back[c] for c in a_of.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_of.id_to_piece(i)]]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append([0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        cuts = sorted(set(np.cumsum([len(x) for x in bytes_a]).tolist()) & set(np.cumsum([len(x) for x in bytes_b]).tolist()))
        parts = defaultdict(lambda: ([], []))
        for k, (ids, pieces) in enumerate(((a, bytes_a), (b, bytes_b))):
            end = 0
            for i, p in zip(ids, pieces, strict=True):
                end += len(p)
                parts[next(c for c in cuts if c >= end)][k].append(i)
        own = Counter((x, y) for p, q in parts.values() for x in p for y in q)
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for _, (p, q) in sorted(parts.items()))
        rows.append([len(a), len(b), len(parts), sum(own.values()), hashlib.sha256(said.encode()).hexdigest()])
        links.append(own)
    held = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for row, own in zip(rows, links, strict=True):
        row[4:4] = [sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items())]
    total = Counter()
    for own in links:
        total.update(own)
    return rows, held, total


def drawn(n, seed=4):
    rng = random.Random(seed)
    words = ["the", " of", "ing", "12", "é", "日本", "\n", "  ", "token", "==", "'s", "Xy", "naïve ", "<s>", "\t"]
    return ["".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]


def test_alignment_matches_a_plain_count(spark):
    texts = ODD + drawn(120) + ["the token " * 40] * 3
    rows, held, total = brute(texts)
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, segment int").repartition(3)
    indexed = align.index(docs, BYTES, PIECES, printed=True, most=700, chunk=900)
    assert indexed.select("segment").distinct().count() > 3
    counts = {(r.a, r.b): (r.docs, r.links) for r in align.pair_counts(indexed).collect()}
    assert counts == {p: (held[p], total[p]) for p in held}
    got = align.scores(indexed).collect()
    assert len(got) == len(texts)
    for r in got:
        want = rows[5 if r.doc_id is None else r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256] == want
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == want[6]
    assert align.align(docs.where("false"), BYTES, PIECES).count() == 0


def test_planes_open_to_what_they_hold():
    rng = np.random.default_rng(3)
    pairs, place = rng.integers(0, 40, 6000), rng.integers(0, 500, 6000)
    keys = np.unique(pairs.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
    links = rng.integers(1, 70, len(keys))
    made = align.planes_of(keys, links, 32000)
    assert any(k % 2 for row in made["kinds"].to_pylist() for k in row) and made["links"].to_numpy().sum() == links.sum()
    row, at, weight = align.opened(made["kinds"], made["bits"])
    sums = Counter()
    for r, p, w in zip(row.tolist(), at.tolist(), weight.tolist(), strict=True):
        sums[made["b"][r].as_py(), p] += w
    assert sums == {(int(k >> np.uint64(32)), int(k & np.uint64(0xFFFF))): int(n) for k, n in zip(keys, links, strict=True)}


def test_large_groups_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(align, "LINKS", 50)
    texts = [t or "" for t in ODD] + drawn(30)
    got = align.Aligned(align.pair(BYTES, PIECES), texts, 0)
    keys, n = align.counted(np.concatenate(got.keys), np.concatenate(got.links))
    sums = Counter()
    for k, x in zip(keys.tolist(), n.tolist(), strict=True):
        sums[(k >> 32) // 32000, (k >> 32) % 32000] += x
    assert sums == brute(texts)[2]
