"""Removal of repeated byte strings against a count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import repeats


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def drawn(rng, n):
    passage = "".join(rng.choices("abcdefgh é", k=90))
    texts = []
    for _ in range(n):
        own = "".join(rng.choices("abcdefghijklmnop 日", k=rng.randint(0, 200)))
        kind = rng.randint(0, 4)
        if kind == 0 and texts:
            own = rng.choice(texts) or ""
        if kind == 1:
            own = own + passage[: rng.randint(20, 90)] + own[::-1]
        if kind == 2:
            own += rng.choice("xy") * rng.randint(1, 120) + passage[rng.randint(0, 60) :]
        texts.append(own)
    return texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5), st.sampled_from([1, 3, 12]))
def test_runs_cover_each_window_once(texts, gram):
    parts = [t.encode() for t in texts if len(t) >= 12]
    if not parts:
        return
    of, first, n, anchor, mark, loops = repeats.runs_of(parts, 12, gram)
    windows, pieces = {}, {}
    for p, x, k, loop in zip(*(c.tolist() for c in (of, first, n, loops)), strict=True):
        own = [parts[p][i : i + 12] for i in range(x, x + k)]
        assert loop or len(set(own)) == len(own)
    seen = [(p, i) for p, x, k in zip(of.tolist(), first.tolist(), n.tolist(), strict=True) for i in range(x, x + k)]
    assert seen == [(p, i) for p, t in enumerate(parts) for i in range(len(t) - 11)]
    for p, x, k, a, m in zip(*(c.tolist() for c in (of, first, n, anchor, mark)), strict=True):
        for i in range(x, x + k):
            assert windows.setdefault(parts[p][i : i + 12], a) == a
        assert pieces.setdefault((a, m), parts[p][x : x + k + 11]) == parts[p][x : x + k + 11]


@pytest.mark.parametrize(
    "limits",
    [{}, {"most": 2, "shard_bytes": 500, "rows_held": 100, "names_held": 40}, {"most": 1, "chunk": 64}],
    ids=["as a rule", "small shards that spill and recur", "wide anchors and cut texts"],
)
def test_removed_bytes_match_a_count_of_all_windows(spark, limits):
    window = 32
    texts = ["", None, "short", "z" * 400, "ab" * 150, *drawn(random.Random(6), 60), "z" * 31, "y" * 32]
    docs = spark.createDataFrame([(i if i != 9 else None, t, "o", 3) for i, t in enumerate(texts)], "doc_id long, text string, ord string, weight int")
    got = repeats.remove_repeats(docs.repartition(4), window, **limits).collect()
    want = brute(texts, window)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[9 if r.doc_id is None else r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 2000


def test_no_rows_and_nothing_long_enough(spark):
    docs = spark.createDataFrame([(1, "a" * 199), (1, None)], "doc_id long, text string")
    assert repeats.remove_repeats(docs.where("false")).count() == 0
    assert sorted(tuple(r)[:4] for r in repeats.remove_repeats(docs).collect()) == [(1, 0, 0, 0), (1, 199, 0, 0)]


def test_equal_rows_of_one_document_repeat_each_other(spark):
    rng = random.Random(1)
    one, two = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(2))
    docs = spark.createDataFrame([(1, one), (1, one), (None, two), (None, two), (2, one[:50] + two[:100])], "doc_id long, text string")
    for limits in ({}, {"most": 0}):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs, 64, **limits).collect())
        assert got == [(0, 300, 300), (0, 300, 300), (1, 300, 300), (1, 300, 300), (2, 150, 100)]
