"""Which field is the event clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import STRATEGIES, non_empty

SAMPLE = 20_000


def rank_clocks(cells: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Fields that parse as times in the first `most` records, best first.

    A field needs values in half of the sample and ten at least; its strategy
    is the first to read nine tenths of them. Score: parse rate times half of
    one plus the share of adjacent times that don't go back. Ties go to the
    name. The sample bounds the window that compares neighbours. Records are
    taken in order of pos, whatever their numbers.
    """
    fields = cells.select("field").distinct().count()
    # the first `most` records have at most this many cells; one number comes to the driver
    head = cells.select("pos").orderBy("pos").limit(most * max(1, fields))
    last = head.select("pos", F.dense_rank().over(Window.orderBy("pos")).alias("place")).filter(F.col("place") <= most).agg(F.max("pos")).first()[0]
    first = cells.filter(F.col("pos") <= F.lit(last))
    size = first.agg(F.countDistinct("pos").alias("size"))
    long = reduce(DataFrame.unionByName, [first.filter(non_empty(F.col("sval"))).select("pos", "field", F.lit(n).alias("strategy"), F.lit(i).alias("place"), f(F.col("sval")).alias("t")) for i, (n, f) in enumerate(STRATEGIES)])
    rate = long.groupBy("field", "strategy", "place").agg(F.count("*").alias("n"), F.count("t").alias("ok"), F.min("t").alias("first"), F.max("t").alias("last")).crossJoin(F.broadcast(size))
    rate = rate.filter((F.col("n") >= F.greatest(F.lit(10), F.col("size") * 0.5)) & (F.col("ok") >= 0.9 * F.col("n")))
    best = rate.groupBy("field").agg(F.min_by(F.struct("strategy", "n", "ok", "first", "last"), "place").alias("b")).select("field", "b.*")
    step = F.lag("t").over(Window.partitionBy("field", "strategy").orderBy("pos"))
    mono = long.filter("t is not null").join(F.broadcast(best.select("field", "strategy")), ["field", "strategy"]).withColumn("before", step).filter("before is not null").groupBy("field").agg(F.avg((F.col("t") >= F.col("before")).cast("double")).alias("m"))
    out = best.join(mono, "field", "left").withColumn("parse_rate", F.col("ok") / F.col("n")).withColumn("monotonic", F.coalesce("m", F.lit(1.0)))
    out = out.withColumn("score", F.col("parse_rate") * (0.5 + 0.5 * F.col("monotonic")))
    return out.select("field", "strategy", "parse_rate", "monotonic", "first", "last", ((F.col("last") - F.col("first")) / 1e6).alias("span_s"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "field")).alias("rank"))
