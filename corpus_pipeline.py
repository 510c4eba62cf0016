"""A corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sediment.llm._scratch import Scratch
from sediment.llm.decontamination import decontaminate
from sediment.llm.language_id import accepted_documents, train
from sediment.llm.minhash_dedup import near_duplicates
from sediment.llm.secret_scan import redact_documents
from sediment.llm.sentencepiece_codec import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure enough of; learnt from all labelled texts, whole, of four fifths of them.

    Texts that are null, empty or without a letter go, as their language can't
    be told. Rows are judged one by one, by their whole text: repeated rows
    alike, rows without doc_id too (they aren't learnt from). Without labels
    nothing is learnt and all documents go. Empty tables give no rows.
    """
    model = train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return accepted_documents(docs, model)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Of rows that share the kept doc_id one stays, that with the smallest text,
    null first. Rows without doc_id can't be told apart and all stay, as do
    texts without words, each under its own doc_id. Empty tables give no rows.
    """
    found = near_duplicates(docs).groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    found = Scratch(spark, "kept").save(found, "ids")
    # Texts stay where they lie unless more ids than that go or occur more than once
    def ids(where: str) -> DataFrame:
        some = found.filter(where).select(F.col("doc_id").alias("of"))
        return F.broadcast(some) if some.limit(FEW + 1).count() <= FEW else some

    mine = F.col("doc_id").cast("long") == F.col("of")
    more = docs.join(ids("kept and rows > 1"), mine, "left_semi")
    first = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in ("text", *(f.name for f in docs.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double") and f.name != "text"))])
    more = more.withColumn("dedup: place", F.row_number().over(first)).filter(F.col("dedup: place") == 1)
    return docs.join(ids("not kept or rows > 1"), mine, "left_anti").union(more.select(*[F.col(f"`{c}`") for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do rows without doc_id that
    hold none; repeated rows are judged alike. Texts are searched whole. An
    empty benchmark leaves all documents, an empty table gives no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted again.

    Null and empty texts, repeated rows and rows without doc_id stay as they
    are, or are redacted alike. Texts are scanned whole, in time that grows with
    their length. Empty tables give no rows.
    """
    return redact_documents(docs, Scratch(spark, "secrets"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text, of each document.

    A null text is empty and has no ids; rows are encoded one by one, whole,
    repeated rows and rows without doc_id too. Empty tables give no rows.
    """
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: Most ids that are broadcast, some 40 bytes each.
FEW = 50_000

STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: Language identification, near-dedup, tiling and encoding aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of sf_dir."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = tmp.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i > 1:
            tmp.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
