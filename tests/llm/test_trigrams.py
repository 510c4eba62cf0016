"""The trigram model against dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sediment.llm import ngram_lm
from test_operators import empty_docs, some_docs, words


def kn3(docs, train):
    seqs = {i: words(t) + ["</s>"] for i, t in docs}
    c, raw, tri = Counter(), Counter(), Counter()
    for i in train:
        s = ["<s>", *seqs[i]]
        c.update(seqs[i])
        raw.update(zip(s, s[1:]))
        tri.update(zip(s, s[1:], s[2:]))
    ends = Counter((v, w) for _, v, w in tri)
    bi = {k: n if k[0] == "<s>" else ends[k] for k, n in raw.items()}
    cont = Counter(w for _, w in raw)
    d1, d2, d3 = (ngram_lm.discounts(*[Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in (cont, bi, tri))
    less = lambda n, d: n - (0 if n == 0 else d[min(n, 3) - 1])
    g0 = sum(n - less(n, d1) for n in cont.values()) / len(raw)
    two, three = defaultdict(list), defaultdict(list)
    for (v, _), n in bi.items():
        two[v].append(n)
    for (u, v, _), n in tri.items():
        three[u, v].append(n)
    out = {}
    for i, seq in seqs.items():
        s, total = ["<s>", *seq], 0.0
        for k in range(1, len(s)):
            v, w = s[k - 1], s[k]
            p = less(cont[w], d1) / len(raw) + g0 / (len(c) + 1)
            if v in two:
                p = less(bi.get((v, w), 0), d2) / sum(two[v]) + sum(n - less(n, d2) for n in two[v]) / sum(two[v]) * p
            x = three.get((s[k - 2], v)) if k > 1 else None
            if x:
                p = less(tri[s[k - 2], v, w], d3) / sum(x) + sum(n - less(n, d3) for n in x) / sum(x) * p
            total += math.log10(p)
        out[i] = total
    return out


def test_trigram_model(spark):
    df = some_docs(spark, 60)[1].filter("length(text) < 20000 or text is null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    want = kn3(rows, [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    got = {r.doc_id: r.score for r in ngram_lm.score_documents(df, held, order=3).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}
    assert ngram_lm.score_documents(empty_docs(spark), held, order=3).count() == 0
    assert [r.n_known for r in ngram_lm.score_documents(df.limit(2), F.lit(True), order=3).collect()] == [0, 0]
