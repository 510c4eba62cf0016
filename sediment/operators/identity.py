"""What identifies a session, an entity or a mere category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalars import is_placeholder

VERDICTS = ("session", "entity", "bucket", "undetermined", "noise")
_DAY = 86400e6
_SPAN_BITS = 28  # four and a half minutes of microseconds
_CLASSES = 64  # classes of values in an octave
_BUCKETS = 4096  # classes of a key's hash
_HEAVY = 500_000  # rows of such a class that are dealt by key whatever its share


def measure(records: DataFrame, keys: list[tuple[str, ...]], clock: Column | None = None, partial: bool = False, shapes: dict[str, str] | None = None) -> DataFrame:
    """A row of statistics and a verdict for each candidate key; clock: microseconds or null.

    Rows are counted by classes of their keys' hash first. The keys of a class
    within a small share of the table are dealt whole, once, and read in order
    of time; those of a larger one, which may be a key that holds most of the
    table, are spread by time. A record counts for a key if no part of it is
    null, empty or the text None.
    """
    t = F.lit(None).cast("long") if clock is None else clock
    dealt = _deal(records, keys, t)
    of_hash = reduce(DataFrame.unionByName, [r.select("candidate", "bucket", "masked", "t") for r in dealt]).groupBy("candidate", "bucket")
    of_hash = of_hash.agg(F.count("*").alias("n"), F.count("t").alias("nt"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum("masked").alias("masked"))
    top = F.array_compact(F.collect_list(F.when(F.col("n") > _HEAVY, F.struct("n", "bucket"))))
    # A row a candidate comes to the driver, with the classes over the share of it: fewer than _BUCKETS / 8
    of_all = of_hash.groupBy("candidate").agg(*[F.sum(n).alias(n) for n in ("n", "nt", "masked")], F.min("t0").alias("t0"), F.max("t1").alias("t1"), top.alias("top"))
    heavy_of = F.transform(F.filter("top", lambda x: x["n"] > F.col("n") * (8 / _BUCKETS)), lambda x: x["bucket"])
    found = of_all.select("candidate", "n", "nt", "masked", "t0", "t1", heavy_of.alias("heavy")).collect()
    a = records.sparkSession.createDataFrame([tuple(r)[:6] for r in found], "candidate int, n long, nt long, masked long, t0 long, t1 long")
    heavy, dealt = F.lit(False), [r.drop("masked") for r in dealt]
    for r in found:
        if r.heavy:
            heavy = heavy | (F.col("candidate") == r.candidate) & F.col("bucket").isin(*r.heavy)
    values = [_whole(r.filter(~heavy).drop("bucket")) for r in dealt]
    if any(r.heavy for r in found):
        values += [_spread(r.filter(heavy).drop("bucket")) for r in dealt]
    # Kept until the frame is gone: Spark doesn't share shuffles over kept records, and three readers follow
    values = _histogram(reduce(DataFrame.unionByName, values)).localCheckpoint()
    of_size = F.when(F.col("of") == "size", F.col("k"))
    g = values.groupBy("candidate").agg(F.sum(of_size).alias("groups"), F.coalesce(F.sum(F.when(F.col("v") == 1, of_size)), F.lit(0)).alias("singletons"))
    m = medians(values)
    m = m.groupBy("candidate").agg(*[F.max(F.when(F.col("of") == of, F.col("median") * scale)).alias(name) for of, name, scale in (("size", "p95_size", 1), ("own", "own_days", 1 / _DAY), ("rate", "own_rate", _DAY), ("gap", "median_gap_s", 1e-6))])
    out = g.join(F.broadcast(a), "candidate").join(F.broadcast(m), "candidate")
    names = F.array(*[F.lit("+".join(k)) for k in keys])
    span, rate = (F.col("t1") - F.col("t0")) / _DAY, F.when(F.col("span_days") > 0, F.col("nt") / F.col("span_days"))
    out = out.select(F.element_at(names, F.col("candidate") + 1).alias("candidate"), "groups", "singletons", (F.col("n") / F.col("groups")).alias("mean_size"), span.alias("span_days"), (F.col("masked") / F.col("n")).alias("placeholder_rate"), F.col("p95_size").cast("long").alias("p95_size"), "own_days", "own_rate", "median_gap_s", "nt")
    shape = F.lit("token")
    for f, s in (shapes or {}).items():
        shape = F.when(F.col("candidate") == f, s).otherwise(shape)
    return out.withColumn("rate_per_day", rate).withColumn("verdict", verdict(shape, partial)).drop("nt")


def _deal(records: DataFrame, keys: list[tuple[str, ...]], t: Column) -> list[DataFrame]:
    """candidate, the parts of a key, bucket, masked, t: rows of keys, a table for each list of types; whole numbers stay numbers."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    number = {f: isinstance(kinds[f], IntegralType) for k in keys for f in k}
    alike: dict[tuple, list] = {}
    for i, k in enumerate(keys):
        fields = sorted(k, key=lambda f: not number[f])
        ok, masked, parts = F.lit(True), F.lit(False), []
        for f in fields:
            c = F.col(f"`{f}`")
            if number[f]:
                ok, part = ok & c.isNotNull(), c.cast("long")
            else:
                part = c.cast("string")
                ok, masked = ok & part.isNotNull() & ~part.isin("None", ""), masked | is_placeholder(part)
            parts.append(part)
        x = F.struct(F.lit(i).alias("candidate"), *[p.alias(f"k{j}") for j, p in enumerate(parts)], masked.cast("int").alias("masked"))
        alike.setdefault(tuple(number[f] for f in fields), []).append(F.when(ok, x))
    out = []
    for kind, options in alike.items():
        rows = records.select(t.alias("t"), F.explode(F.array(*options)).alias("c")).filter("c is not null").select("c.*", "t")
        out.append(rows.withColumn("bucket", F.pmod(F.hash(*[f"k{j}" for j in range(len(kind))]), F.lit(_BUCKETS))))
    return out


def _key(rows: DataFrame) -> list[str]:
    return ["candidate", *[c for c in rows.columns if c[0] == "k" and c[1:].isdigit()]]


def _of(name: str, v: Column, k: Column | int = 1) -> Column:
    return F.struct(F.lit(name).alias("of"), v.cast("double").alias("v"), (F.lit(k) if isinstance(k, int) else k).cast("long").alias("k"))


def _values(rows: DataFrame, options: Column) -> DataFrame:
    return rows.select("candidate", F.explode(options).alias("x")).select("candidate", "x.*").filter("v is not null and k > 0")


def _sums(n: Column, nt: Column, own: Column) -> list[Column]:
    """size, own span and rate of a key; without two times it has a size only."""
    timed = nt >= 2
    return [_of("size", n), _of("own", F.when(timed, own)), _of("rate", F.when(timed, F.try_divide(nt, own.cast("double"))))]


def _whole(rows: DataFrame) -> DataFrame:
    """candidate, of, v, k: gaps, in microseconds, and sums of keys, each in one task; rows without a time come first."""
    w = Window.partitionBy(*_key(rows)).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = rows.select("candidate", "t", (F.col("t") - F.lag("t").over(w)).alias("gap"), F.lead(F.lit(1)).over(w).isNull().alias("last"), F.row_number().over(w).alias("n"), F.count("t").over(upto).alias("nt"), F.min("t").over(upto).alias("t0"))
    gap = _of("gap", F.col("gap"))
    return _values(x, F.when(F.col("last"), F.array(gap, *_sums(F.col("n"), F.col("nt"), F.col("t") - F.col("t0")))).otherwise(F.array(gap)))


def _spread(rows: DataFrame) -> DataFrame:
    """The same of keys of any size.

    A key's times are counted, and cut into spans of the clock, so that
    neighbours are found span by span wherever they lie; the last time of a
    span meets the first of the next one. A key has one row a span.
    """
    key = _key(rows)
    times = rows.groupBy(*key, "t").agg(F.count("*").alias("m")).withColumn("span", F.shiftright("t", _SPAN_BITS))
    # Sums are kept in one column: what follows reads it whole, so that one shuffle serves all readers
    timed = F.when(F.col("t").isNotNull(), F.col("m"))
    spans = times.groupBy(*key, "span").agg(F.struct(F.sum("m").alias("n"), F.sum(timed).alias("nt"), F.min("t").alias("t0"), F.max("t").alias("t1")).alias("q"))
    per = spans.groupBy(*key).agg(F.sum("q.n").alias("n"), F.sum("q.nt").alias("nt"), F.min("q.t0").alias("t0"), F.max("q.t1").alias("t1"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*key, "span").orderBy("t"))
    same = F.when(F.col("t").isNotNull(), F.lit(0))
    inner = _values(times.withColumn("gap", gap), F.array(_of("gap", F.col("gap")), _of("gap", same, F.col("m") - 1)))
    step = F.col("q.t0") - F.lag("q.t1").over(Window.partitionBy(*key).orderBy("span"))
    outer = _values(spans.withColumn("step", step), F.array(_of("gap", F.col("step"))))
    return _values(per, F.array(*_sums(F.col("n"), F.col("nt"), F.col("t1") - F.col("t0")))).unionByName(inner).unionByName(outer)


def _histogram(values: DataFrame) -> DataFrame:
    return values.groupBy("candidate", "of", "v").agg(F.sum("k").alias("k"))


def medians(values: DataFrame) -> DataFrame:
    """candidate, of, median of values(candidate, of, v, k), k times v, none below zero; of sizes the one at 0.95 of the ranks, rounded down.

    Exact, without a task that holds all values of a group: sums over classes
    of values within about one percent find the class of the middle ranks; only
    its distinct values are put in order.
    """
    size = F.when(F.col("v") > 0, F.floor(F.log2("v") * _CLASSES)).otherwise(-1_000_000)
    h = _histogram(values).withColumn("class", F.coalesce(size, F.lit(-1_000_000)))
    of = Window.partitionBy("candidate", "of")
    c = h.groupBy("candidate", "of", "class").agg(F.sum("k").alias("k"))
    c = c.withColumn("upto", F.sum("k").over(of.orderBy("class"))).withColumn("all", F.sum("k").over(of))
    p95 = F.when(F.col("of") == "size", F.floor(0.95 * (F.col("all") - 1)))
    low, high = F.coalesce(p95, F.floor((F.col("all") - 1) / 2)), F.coalesce(p95, F.floor(F.col("all") / 2))
    c = c.withColumn("low", low).withColumn("high", high).filter((F.col("upto") > F.col("low")) & (F.col("upto") - F.col("k") <= F.col("high")))
    c = c.select("candidate", "of", "class", (F.col("upto") - F.col("k")).alias("before"), "low", "high")
    x = h.join(F.broadcast(c), ["candidate", "of", "class"])  # two classes at most of each statistic of each candidate
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("candidate", "of", "class").orderBy("v"))
    x = x.withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("k") <= F.col(rank)), F.col("v")))
    return x.groupBy("candidate", "of").agg(((at("low") + at("high")) / 2).alias("median"))


def verdict(shape: Column, partial: bool) -> Column:
    """The decision on a row of measure()."""
    one, mean, own, span = F.col("singletons") / F.col("groups"), F.col("mean_size"), F.col("own_days"), F.col("span_days")
    tight = own / span < 0.05
    timed = F.when(tight & (mean < 1000), "session").when(mean >= 50, "bucket").otherwise("entity")
    plain = F.when(mean >= 50, "bucket").when(mean >= 2, "entity").otherwise("noise")
    return (
        F.when((shape == "free-text") & (mean < 5), "noise")
        .when(F.col("placeholder_rate") > 0.5, "noise")
        .when(one > 0.95, "undetermined" if partial else "noise")
        .when(own.isNotNull() & (span > 0), timed)
        .otherwise(plain)
    )


def rank_of(c: Column) -> Column:
    return F.when(c == "session", 0).when(c == "entity", 1).when(c == "bucket", 2).when(c == "noise", 4).otherwise(3)


def pair_candidates(singles: list[dict], records: int) -> list[tuple[str, str]]:
    """Pairs of the eight most selective fields that measured as a session, entity or bucket and aren't masked."""
    pool = [s for s in singles if s["verdict"] in ("session", "entity", "bucket") and s["placeholder_rate"] < 0.5]
    pool = sorted(pool, key=lambda s: (-s["groups"] / max(1, records), s["candidate"]))[:8]
    names = sorted(s["candidate"] for s in pool)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def evidence(r: dict, partial: bool = False) -> str:
    """Why a row of measure() got its verdict, in words."""
    one = r["singletons"] / r["groups"] if r["groups"] else 0
    if r["placeholder_rate"] > 0.5:
        return f"{r['placeholder_rate']:.0%} of values are redaction placeholders: no identity key"
    if r["verdict"] == "undetermined":
        return f"{one:.0%} of keys appear once, but the scan is a prefix of the timeline; Rescan without --limit"
    if one > 0.95:
        return f"{one:.0%} of keys appear exactly once"
    own, span = r["own_days"], r["span_days"]
    where = f"over a median of {own * 1440:,.0f} minutes ({own / span:.1%} of the timeline)" if own is not None and span else "without a usable clock"
    tail = {"session": ", a burst", "entity": ", a long-lived thread", "bucket": ": a category, not a thing", "noise": ": prose or unique values"}[r["verdict"]]
    return f"{r['mean_size']:,.1f} events per key {where}{tail}"


def claims(measured: DataFrame, claimed: DataFrame) -> DataFrame:
    """claimed, verdict, holds of each claimed(claimed) key: its fields joined by +, in any order, against measure()'s rows."""
    fields = lambda c: F.array_sort(F.split(c, "[+]"))
    m = measured.select(fields("candidate").alias("of"), "verdict")
    out = claimed.select("claimed", fields("claimed").alias("fields")).join(m, F.col("fields") == F.col("of"), "left")
    return out.select("claimed", "verdict", F.coalesce(F.col("verdict").isin("session", "entity"), F.lit(False)).alias("holds"))
