"""The registered queries and the pipeline on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import Row

import corpus_pipeline
from sediment.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_ten_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "decontamination", "secret_scan", "sentencepiece"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[1] >= 0.98 * counts[0]
    assert not docs.filter("text rlike '[0-9a-f]{24,}'").count()
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLE[name])
    df, names = QUERIES[name](spark, SF), [d[0] for d in cur.description]
    assert sorted(map(str, df.select(names).collect())) == sorted(str(Row(**dict(zip(names, r)))) for r in cur.fetchall())
