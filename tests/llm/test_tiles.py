"""Greedy tiling against a search for the longest free match before every tile."""

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import decontamination
from sediment.llm.decontamination import Benchmark, tiles


def brute(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return out
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
        out.append(best)


def h(words):
    return np.array([int(w) * 0x9E3779B97F4A7C15 % 2**64 for w in words], dtype=np.uint64)


def test_remainders_keep_their_place():
    a, b = "1 2 1 2 1 2 2 1 1 1 2 2 2 2 1 2 1".split(), "1 1 2 1 2 2 2 2 2 1 2 1 1 1 2 1 1 1 1 2 2 2 1 1 1 2".split()
    assert [t[2] for t in tiles(h(a), h(b), 3)] == [7, 5, 4]


@pytest.mark.parametrize("letters", [2, 3, 6])
def test_against_brute_force(letters, monkeypatch):
    monkeypatch.setattr(decontamination, "_PAIRS", 7)
    rng = np.random.default_rng(letters)
    for _ in range(150):
        a, b = (rng.integers(1, letters + 1, rng.integers(1, n)).tolist() for n in (22, 30))
        for least in (1, 2, 3, 5):
            assert tiles(h(a), h(b), least) == brute(a, b, least)


def test_find_against_brute_force(monkeypatch):
    """Texts of few words, many items with a common opening, a bounded number of entries at a time."""
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(9)]
    items = ["the same opening of all " + " ".join(rng.choice(vocab, rng.integers(1, 12))) for _ in range(30)] + ["w1 w2", "", "w3 w4 w5 w6", "w1 w2 w3 w4 w5"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 60))) for _ in range(40)] + [f"{items[0]} {items[3]}", "w9 " + items[1], "", "w1 w2 w3", " ".join(items[:9])]
    for most in (3, 2_000_000):
        monkeypatch.setattr(decontamination, "_PAIRS", most)
        got = {(r, k): (n, c) for r, k, n, c, _ in Benchmark(list(range(len(items))), items).find(pa.array(texts, pa.string()), 0.75)}
        want = {}
        for r, t in enumerate(texts):
            for k, q in enumerate(items):
                t_, q_ = t.split(), q.split()
                if q_:
                    c = sum(x[2] for x in brute(q_, t_, min(5, len(q_))))
                    if c >= 0.75 * len(q_):
                        want[r, k] = (len(q_), c)
        assert got == want


def test_memory_of_a_common_opening():
    """A thousand items and many texts that share an opening, within bounded memory."""
    import tracemalloc

    items = [f"once upon a time there was a king of number {i} and {i * 7}" for i in range(1000)]
    texts = pa.array(["once upon a time there was a queen"] * 6000, pa.string())
    bench = Benchmark(list(range(1000)), items)
    tracemalloc.start()
    bench.find(texts, 0.75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900e6
