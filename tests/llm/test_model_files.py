"""Model files: many shards under few file descriptors, missing shards, packed blocks."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import ngram_lm as g
from sediment.llm._scratch import Scratch

SCHEMA = "doc_id long, text string"


def some(spark, n=80):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 400)) for i in range(n)], SCHEMA)


def scores(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def test_packed_integers():
    rng = np.random.default_rng(1)
    for x in (np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), np.array([], np.uint64), np.array([2**64 - 1, 0, 5], np.uint64)):
        assert (g._unpacked(g._packed(x)) == x).all()


@pytest.mark.parametrize("order", [2, 3])
def test_shards_and_groups(spark, monkeypatch, order):
    df, held = some(spark), F.col("doc_id") % 5 == 1
    few = scores(g.score_documents(df, held, order))
    monkeypatch.setattr(g, "SHARD_BYTES", 150)
    monkeypatch.setattr(g, "GROUP_WORDS", 7)
    many = scores(g.score_documents(df, held, order))
    assert many == pytest.approx(few, rel=1e-9)


def test_missing_file(spark):
    df, tmp = some(spark), Scratch(spark, "t")
    m = g.train(df, tmp, 3)
    root = m.root.removeprefix("file://")
    os.remove(f"{root}/{sorted(f for f in os.listdir(root) if f.startswith('triple'))[0]}")
    with pytest.raises(Exception, match="No such file"):
        g.score(df, m, F.lit(False)).collect()


def test_few_descriptors():
    """Thousands of mapped files under a limit of 256 descriptors."""
    code = """
import resource, tempfile
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
import numpy as np
from sediment.llm import ngram_lm as g
root = tempfile.mkdtemp()
for s in range(1500):
    g._save(f"file://{root}/word-{s}", hash=np.arange(s, s + 3, dtype=np.uint64), count=np.full(3, s % 200, np.uint8))
a = g.Arrays(f"file://{root}")
for _ in range(2):
    for s in range(1500):
        assert a.get("hash", s).tolist() == [s, s + 1, s + 2] and a.get("count", s)[0] == s % 200
print(len(a.open))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert out.stdout.strip() == "128", out.stderr
