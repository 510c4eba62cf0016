"""Stages on rows with null, repeated and shared ids."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, A), (1, A), (1, A + " z"), (2, A), (None, A), (None, None), (None, A), (3, B), (3, B), (4, None), (4, None), (5, ""), (6, C), (7, C + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.minhash_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(rows_of(got), key=str) == sorted([(1, A), (3, B), (4, None), (5, ""), (6, C)], key=str)
    assert sorted(str(r.text) for r in got.collect() if r.doc_id is None) == sorted(["None", A, A])


def test_null_ids_are_judged_by_text(spark, tmp_path):
    item = "what is the capital of the country that lies north of the river"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "x " + item, "en", "s", 1), (None, A, "en", "s", 1), (2, item, "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1)], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, A), (2, None), (3, "")], key=str)
    secret = spark.createDataFrame([(None, "password=hunter22", "en", "s", 17), (None, "password=hunter22", "en", "s", 17), (4, None, "en", "s", None)], SCHEMA)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.secret_scan(spark, secret, "").collect()), key=str) == sorted([(None, "[secret]", 8)] * 2 + [(4, None, None)], key=str)
    assert corpus_pipeline.sentencepiece(spark, secret, "").count() == 3
