"""Secret scans: texts with very many matches, ledgers kept on disk, exceptions of every kind, keys in PEM form."""

import re
import time

import pytest
from pyspark.sql import functions as F

from sediment.llm import secret_scan as s
from sediment.llm._scratch import Scratch

SCHEMA = "path string, content string"


def brute(text, rules=s.BASE + s.MORE):
    out = []
    for place, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.A):
            if len(m[r.of]) >= r.least:
                out.append((m.start(), place, m.end(), r.kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def found(df):
    return sorted(((r.path, [tuple(x) for x in r.spans]) for r in df.collect()), key=str)


def test_many_matches(spark):
    text = "é password=hunter" + " and secret: abcdefgh1 é" * 100_000
    df = spark.createDataFrame([("a", text)], SCHEMA)
    began = time.time()
    got, _ = s.scan(df, Scratch(spark, "t"))
    assert found(got) == [("a", brute(text))]
    assert time.time() - began < 60


def test_ledger_on_disk(spark):
    rows = [("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("a", "0" * 30), (None, "0" * 30), ("c", None), ("d", ""), ("e", "x ghp_" + "a" * 40)]
    df, tmp = spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")
    uri = tmp.path("ledger")
    first, new = s.scan_into(df.limit(3), tmp, uri, s.BASE)
    assert new.count() == 2 * len(s.BASE)
    want = sorted(((p, brute(c)) for p, c in rows), key=str)
    second, new = s.scan_into(df, Scratch(spark, "t"), uri)
    assert found(second) == want and new.count() == 2 * len(s.MORE) + 2 * len(s.BASE + s.MORE)
    third, new = s.scan_into(df, Scratch(spark, "t"), uri)
    assert found(third) == want and new.count() == 0
    assert spark.read.parquet(uri).count() == 4 * len(s.BASE + s.MORE)


@pytest.mark.parametrize("few", [0, 50_000])
def test_exceptions(spark, monkeypatch, few):
    """Copies and partly scanned blobs, joined by broadcast and by blob."""
    monkeypatch.setattr(s, "FEW", few)
    rows = [(str(i), f"secret=abcdefgh{i % 7} {'f' * 24}") for i in range(60)] + [(str(i), "plain") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, old = s.scan(df.filter("path < '2'"), Scratch(spark, "t"), rules=s.BASE[:2])
    got, new = s.scan(df, Scratch(spark, "t"), old)
    assert found(got) == sorted(((p, brute(c)) for p, c in rows), key=str)
    assert old.join(new, ["blob", "rule", "version"]).count() == 0


def test_pem(spark):
    key = "\n".join(["A1b2" * 16] * 3)
    texts = [f"x -----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----\ny", f"x -----BEGIN PRIVATE KEY-----\n{key}\n\nand prose", "-----BEGIN PRIVATE KEY----- is a header"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in s.redact_documents(docs, Scratch(spark, "t")).collect()}
    assert got == {0: "x [secret]\ny", 1: "x [secret]\n\nand prose", 2: "[secret] is a header"}


def test_redaction_keeps_other_rows(spark):
    rows = [(None, "token=abcdefgh", 14), (1, None, 0), (1, "", 0), (2, "clean", 5), (2, "clean", 5), (3, "token=ab", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("mine"))
    got = sorted((tuple(r) for r in s.redact_documents(docs, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(None, "[secret]", 8, "mine"), *((*r, "mine") for r in rows[1:])], key=str)
    assert s.redact_documents(docs.limit(0), Scratch(spark, "t")).count() == 0
