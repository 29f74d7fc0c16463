"""The fill-in-middle operator against a plain cut of each text, and its way back."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import middle

PARTS = ["a", "bc", " ", "\n", "é", "日本", "😀", "1", "<", "P>", "<P", "S>", "M", ">", "Zz", "<P>", "<S>", "\x00"]


def brute(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=8), st.integers(0, 10**6))
def test_batches_match_plain_cuts(texts, first):
    ids = list(range(first, first + len(texts)))
    if not texts:
        return
    got = middle.scatter(texts, ids, 1, middle.PLAIN_FROM, middle.SPM_BELOW)
    for i, t in enumerate(texts):
        n, form, p, m, out = brute(ids[i], t)
        assert (got["n"][i], got["form"][i], got["output"][i]) == (n, form, out)
        assert form == "plain" or (got["prefix_chars"][i], got["middle_chars"][i]) == (p, m)
    assert middle.gather(got["output"], got["form"].tolist()) == texts


def test_rows(spark):
    rng = random.Random(2)
    texts = ["", None, " ", "<M>", "word " * 30000, "x" * 50000, "é" * 999] + ["".join(rng.choices(PARTS, k=40)) for _ in range(200)]
    ids = [None, 7, 7, *range(3, len(texts))]
    rows = spark.createDataFrame([(i, t, "s") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, restored string")
    got = middle.restore(middle.transform(rows)).collect()
    want = sorted(((i, *brute(i, t), t or "") for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.digests(rows.where("false")).count() == 0
    kept = middle.restore(middle.transform(rows).selectExpr("*", "1 AS text"))
    assert kept.columns[-2:] == ["text", "restored"] and kept.count() == len(texts)


def test_a_lost_mark_is_an_error():
    with pytest.raises(ValueError, match="lacks the mark"):
        middle.gather(["<P>a<S>b"], ["psm"])
