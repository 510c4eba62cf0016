"""What each field holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import SHAPES, is_placeholder, non_empty, stripped

SAMPLES, SHAPE_SAMPLES = 400, 500


def profile_fields(cells: DataFrame) -> DataFrame:
    """present, non_null, exact distinct, fill rate, cardinality, lengths and placeholder rate of each field."""
    full = non_empty(F.col("sval"))
    one = lambda c: F.when(full, c)
    p = cells.groupBy("field").agg(
        F.count("*").alias("present"),
        F.count_if(full).alias("non_null"),
        F.countDistinct(one(F.col("sval"))).alias("distinct"),
        F.sum(one(F.length("sval"))).alias("chars"),
        F.max(one(F.length("sval"))).alias("max_length"),
        F.count_if(full & is_placeholder(F.col("sval"))).alias("placeholders"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return p.select("field", "present", "non_null", "distinct", rate("non_null", "present").alias("fill_rate"), rate("distinct", "non_null").alias("cardinality"), rate("chars", "non_null").alias("mean_length"), F.coalesce("max_length", F.lit(0)).alias("max_length"), rate("placeholders", "non_null").alias("placeholder_rate"))


def dominant_kinds(cells: DataFrame) -> DataFrame:
    """The most frequent type tag of each field; null gives way to any other, ties to the name.

    An empty string counts twice as empty-string, a blank one once.
    """
    n = F.sum(F.when(F.col("sval") == "", 2).otherwise(1))
    c = cells.groupBy("field", "vtype").agg(n.alias("n"))
    best = F.max_by("vtype", F.struct((F.col("vtype") != "null").alias("value"), "n", (-F.ascii("vtype")).alias("first"), F.reverse(F.col("vtype")).alias("rest")))
    return c.groupBy("field").agg(best.alias("kind")).select("field", F.when(F.col("kind") == "null", "always-null").otherwise(F.col("kind")).alias("kind"))


def first_values(cells: DataFrame, most: int) -> DataFrame:
    """The first `most` non-empty values of each field, by pos: one small heap per field and task."""
    w = Window.partitionBy("field").orderBy("pos")
    return cells.filter(non_empty(F.col("sval"))).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= most)


def value_shapes(cells: DataFrame, most: int = SHAPE_SAMPLES) -> DataFrame:
    """The shape that the first values of each field share."""
    v = first_values(cells.withColumn("sval", stripped(F.col("sval"))), most)
    tests = [F.bool_and(F.col("sval").rlike(p)).alias(n) for n, p in SHAPES]
    a = v.groupBy("field").agg(*tests, F.bool_and(~F.col("sval").contains(" ")).alias("no_space"), F.bool_and((F.upper("sval") == F.col("sval")) & (F.lower("sval") != F.col("sval"))).alias("all_upper"), F.avg(F.length("sval")).alias("mean"))
    out = F.lit(None).cast("string")
    rest = F.when(F.col("no_space"), "token").when(F.col("all_upper"), "code").when(F.col("mean") > 40, "free-text").otherwise("token")
    for n, _ in reversed(SHAPES):
        rest = F.when(F.col(n), n).otherwise(rest)
    out = rest
    return cells.select("field").distinct().join(a, "field", "left").select("field", F.when(F.col("mean").isNull(), "empty").otherwise(out).alias("shape"))


def content_rank(cells: DataFrame, most: int = SAMPLES) -> DataFrame:
    """Fields that may carry readable text, with vocabulary reuse and words per value, best first."""
    v = first_values(cells, most)
    sampled = v.groupBy("field").agg(F.countDistinct("sval").alias("distinct"), F.count("*").alias("n"))
    words = v.select("field", F.explode(F.filter(F.split(F.lower("sval"), "[^a-z0-9]+"), lambda x: x != "")).alias("word"))
    c = words.groupBy("field", "word").agg(F.count("*").alias("k")).groupBy("field").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("again"), F.sum("k").alias("words"))
    p = profile_fields(cells).select("field", "fill_rate").join(dominant_kinds(cells), "field")
    out = p.filter(~F.col("kind").isin("int", "float", "bool") & (F.col("fill_rate") >= 0.05)).join(sampled, "field", "left").join(c, "field", "left")
    out = out.select("field", F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce(F.col("again") / F.col("words"), F.lit(0.0)).alias("reuse"), F.coalesce(F.col("words") / F.col("n"), F.lit(0.0)).alias("mean_words"))
    order = Window.orderBy(F.col("distinct") <= 16, -F.col("reuse") * F.col("mean_words"), "field")
    return out.withColumn("rank", F.row_number().over(order))
