"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for each end of links(a, b); component is the smallest id reachable.

    Each round rewires every vertex to its smallest neighbour (large star, then
    small star) and is written to the shared folder, so lineage stays short and a
    lost executor repeats one round at most. The edge count never grows beyond
    the number of links. Self links and repeated links change nothing; no links
    give no rows.
    """
    e = scratch.save(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, i = _state(e), 0
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        i += 1
        nxt = scratch.save(small.filter("u <> v").distinct(), f"{name}-{i}")
        now = _state(nxt)
        scratch.drop(f"{name}-{i - 1}")
        e = nxt
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Changes unless the edges are already stars."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
    return tuple(r)
