"""Near-dedup: repeated ids, hubs dealt over salts, and how many pairs at the threshold the estimates keep."""

import numpy as np

from sediment.llm import minhash_dedup as m

SCHEMA = "doc_id long, text string"


def text(*words):
    return " ".join(f"w{i}" for i in words)


def test_one_id_with_two_texts(spark):
    a, b = range(60), range(1000, 1060)
    rows = [(1, text(*a)), (1, text(*b)), (2, text(*a, 7)), (3, text(*b, 9)), (4, text(*range(500, 560))), (4, ""), (2, text(*a, 7))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in m.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]


def test_a_hub_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(m, "_PAIRS_OF_A_SALT", 4)
    monkeypatch.setattr(m, "FEW", 3)
    base = list(range(80))
    rows = [(100 + i, text(*base, 2000 + i)) for i in range(60)] + [(1000 + i, text(*range(5000 + 90 * i, 5080 + 90 * i))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 100 if i < 1000 else i for i, _ in rows}


def test_recall_near_the_threshold():
    """Sets of 300 to 3000 hashes that share 0.75 to 0.80: none is lost by signatures or sketches."""
    rng = np.random.default_rng(8)
    for _ in range(1500):
        union, share = int(rng.integers(300, 3000)), rng.uniform(0.75, 0.8)
        both = int(np.ceil(union * share))
        h = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, union, dtype=np.uint64)
        cut = both + int(rng.integers(0, union - both + 1))
        x, y = np.sort(h[:cut]), np.sort(np.r_[h[:both], h[cut:]])
        assert (m.signature(x) != m.signature(y)).sum() <= m.DISTANCE
        assert m._likely(*((s[: m.SKETCH] >> np.uint64(32)).astype(np.uint32) for s in (x, y)), 75)
