"""External induced sorting against sorting all suffixes outright."""

import os
import random
import tempfile

import numpy as np
import pytest

from cohortspark.llm import suffixes as S


def sort_outright(symbols, depth):
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])[::-1]
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < depth and max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        shared.append(n)
    return order, shared


def induced(symbols, depth, width, rows_held, names_held, block):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "text")
        with open(path, "wb") as f:
            f.write(np.array(symbols, f">u{width}").tobytes() + S.Text.pad(len(symbols), width))
        got = list(S.suffixes(S.Text(path, len(symbols), width), depth, folder, rows_held, names_held))
        left = os.listdir(folder)
    return np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got]).tolist(), left


@pytest.mark.parametrize("rows_held, names_held, block", [(10**6, 10**6, 1 << 15), (10**6, 8, 1 << 15), (13, 3, 7), (40, 25, 5)])
@pytest.mark.parametrize("width", [1, 4])
def test_order_and_shared_prefixes(monkeypatch, rows_held, names_held, block, width):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "READ", 11 if block < 10 else 1 << 20)
    rng = random.Random(rows_held + width)
    for k in range(60):
        top = rng.choice([1, 2, 3, 200])
        symbols = [rng.randint(1, top) for _ in range(rng.randint(0, 120))]
        if k % 3 == 0:
            symbols = symbols * 3
        if k % 7 == 0:
            symbols = [1 + i % 2 for i in range(100)] + [2] * 40 + [1] * 40
        symbols = symbols + [0]
        got, shared, _ = induced(symbols, 10**4, width, rows_held, names_held, block)
        assert (got, shared) == sort_outright(symbols, 10**4), (k, symbols)


@pytest.mark.parametrize("names_held", [10**6, 5])
def test_a_bounded_depth_is_exact_up_to_it(monkeypatch, names_held):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(9)
    for _ in range(60):
        piece = [rng.randint(1, 3) for _ in range(30)]
        symbols = [s for _ in range(6) for s in (*piece[: rng.randint(5, 30)], *[rng.randint(1, 3)] * rng.randint(0, 30), 0)]
        depth = 9
        got, shared, _ = induced(symbols, depth, 1, 50, names_held, 16)
        heads = [tuple(symbols[i : i + depth]) for i in got]
        assert sorted(got) == list(range(len(symbols)))
        inside = [h for i, h in zip(got, heads, strict=True) if len(h) == depth]
        assert inside == sorted(inside, reverse=True)
        for i in range(1, len(got)):
            x, y = heads[i - 1], heads[i]
            if len(x) == len(y) == depth and 0 not in x[:-1] + y[:-1]:
                assert shared[i] == next((k for k in range(depth) if x[k] != y[k]), depth)
