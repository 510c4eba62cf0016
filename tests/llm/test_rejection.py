"""Rejection: the threshold leaves the share of rows that it was asked for, and texts of unlearned scripts fall below."""

import random

from pyspark.sql import functions as F

from sediment.llm import language_id as l


def test_share_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    clean = docs.filter("lang is not null and text rlike '[a-z]'")
    low = None
    for share in (0.0, 0.02, 0.2):
        m = l.train(docs.filter(fold != 0), per_language=120, reject_share=share)
        assert low is None or m.threshold >= low
        low = m.threshold
        rejected = 1 - l.predict(clean, m, []).filter("accepted").count() / clean.count()
        assert rejected <= share + 0.02
        # below the bound of 0.5, as much is rejected as was asked for
        assert m.threshold == 0.5 or abs(rejected - share) < 0.04
    rng = random.Random(1)
    noise = spark.createDataFrame([(i, "".join(rng.choice("qxzjwvkq") for _ in range(2)) + " 12 %") for i in range(200)], "doc_id long, text string")
    strict = l.train(docs.filter(fold != 0), per_language=120, reject_share=0.01)
    got = l.predict(noise, strict, ["doc_id"])
    assert got.filter("accepted").count() < l.predict(clean, strict, []).filter("accepted").count() / clean.count() * 200


def test_calibration_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert l.train(none).threshold == 1.0
    one = spark.createDataFrame([(1, "12 34", "en"), (2, "ab", "en")], "doc_id long, text string, lang string")
    assert 0 < l.train(one).threshold <= 0.5
