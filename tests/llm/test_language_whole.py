"""Language identification learns from every labelled row, whole, and is calibrated on all of them."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sediment.llm import language_id as l


def words_of_rows(n):
    """Rows of two languages that share their common words; each has one word of its own, some behind 5,000 characters."""
    rng = random.Random(7)
    common = "the same words stand in all texts "
    words = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(n)]
    return words, [(i, common * (150 if i % 40 == 0 else 1) + w, "ab"[i % 2]) for i, w in enumerate(words)]


def test_every_row_is_learnt(spark):
    words, rows = words_of_rows(1500)
    model = l.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    right = {r.doc_id for r in l.predict(asked, model, ["doc_id"]).collect() if r.lang_pred == "ab"[r.doc_id % 2]}
    # Some words have hardly a gram that the other language hasn't got
    assert len(right) > 0.95 * 1500
    assert len([i for i in right if i % 40 == 0]) > 0.9 * 38


def test_counts_are_those_of_whole_texts(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["uno", "Zwei", "trois", "é", "4", "quattuor"]) for _ in range(rng.randint(0, 40))), f"l{i % 90}", i // 90 % 2) for i in range(400)]
    rows.append(("long text " * 200_000, "l1", 0))
    labels, n, has = l._counts(spark.createDataFrame(rows, "text string, lang string, half int").repartition(3), 4096)
    assert labels == sorted({r[1] for r in rows}) and has.all()
    want = np.zeros_like(n)
    for text, lang, half in rows:
        for idx in l.features(np.frombuffer(text.encode(), np.uint8), 4096):
            want[half, labels.index(lang)] += np.bincount(idx[idx >= 0], minlength=4096)
    assert (n == want).all()


def test_threshold_is_the_score_at_its_rank_among_all_rows(spark):
    model = l.LanguageModel(["a", "b"], np.zeros((2, 2), np.float32), np.zeros(2), 0.5, 0.0)
    rng = np.random.default_rng(1)
    z = np.round(rng.normal(0, 1, (50_000, 2)), 2)
    judged = spark.createDataFrame([(0, r) for r in z.tolist()], "label int, z array<double>").repartition(5)
    scores = np.sort(l._softmax(z / 0.5).max(axis=1))
    for rank in (0, 25, 17_321, 49_999):
        assert l._confidence(judged, model, rank) == scores[rank]


def test_rows_are_judged_by_what_others_taught(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(l, "_confidence", lambda judged, model, rank: seen.append((judged.count(), rank)) or 0.4)
    rows = [(i, f"text {i % 50}", "ab"[i % 2]) for i in range(25_000)] + [(-1, "12", "a"), (-2, None, "a"), (-3, "alone", "c")]
    model = l.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), reject_share=0.01)
    assert seen == [(25_000, 250)] and model.threshold == 0.4 and model.labels == ["a", "b", "c"]


def test_pipeline_learns_from_every_row(spark, monkeypatch):
    words, rows = words_of_rows(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = []
    monkeypatch.setattr(corpus_pipeline, "accepted_documents", lambda docs, model: models.append(model) or docs)
    corpus_pipeline.language_id(spark, docs, "")
    learnt = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    asked = spark.createDataFrame([(r.doc_id, words[r.doc_id]) for r in learnt.select("doc_id").collect()], "doc_id long, text string")
    right = Counter(r.lang_pred == "ab"[r.doc_id % 2] for r in l.predict(asked, models[0], ["doc_id"]).collect())
    assert right[False] < 0.02 * asked.count()
