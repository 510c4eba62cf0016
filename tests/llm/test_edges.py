"""All queries and the pipeline on tables with nulls, repeated rows, long texts and clashing columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sediment.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CLASH = ("accepted", "lang_pred", "score", "kept", "component_id", "n_links", "n_shingles", "n_tokens", "held_out", "start", "path", "content", "spans", "row", "pos", "words", "hash", "payload_digest", "record_type", "n", "a", "b", "id", "place", "item", "coverage", "blob", "ids", "part", "size", "turns", "loss", "u", "v")
#: Tables whose rows may be null in every column but the key, or null in all of them.
KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        d = spark.read.parquet(f"{SF}/{name}.parquet")
        top = d.orderBy(*d.columns).limit(60)
        blank = top.limit(1).select(*[F.lit(-7).cast(t).alias(c) if c == KEYS[name] else F.lit(None).cast(t).alias(c) for c, t in d.dtypes])
        void = top.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in d.dtypes])
        out = top.unionByName(top.limit(3)).unionByName(blank).unionByName(void)
        if name == "documents":
            texts = {-8: "", -9: "Wort " * 60_000, -10: "x" * 300_000, -11: " \t\n ", -12: "\U0001f600�  1"}
            for i, t in texts.items():
                out = out.unionByName(blank.withColumn("doc_id", F.lit(i).cast("long")).withColumn("text", F.lit(t)))
        extra = [F.lit("extra").alias(c) for c in CLASH if c not in d.columns]
        out.select("*", *extra).coalesce(2).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_tables(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    table = {"op1": "embeddings", "op6": "pages", "op8": None}.get(name.split("_")[0], "documents")
    if table:
        keys = {r[0] for r in spark.read.parquet(f"{odd}/{table}.parquet").select(KEYS[table]).collect()} - {None}
        assert {r[KEYS[table]] for r in got} - {None} <= keys
        if not name.startswith("op9"):
            assert {r[KEYS[table]] for r in got} - {None} == keys


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(QUERIES[name](spark, empty).collect()) == (1 if name.startswith("op8") else 0)


def test_pipeline(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, names = stage(spark, docs, odd).persist(), docs.columns
        assert docs.columns == names and not docs.filter("score <> 'extra' or spans <> 'extra'").count()
    assert docs.count() > 40 and corpus_pipeline.run(spark, odd).count() == docs.count()
