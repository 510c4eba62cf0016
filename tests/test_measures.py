"""Measures against brute force: gaps and medians over spans, clocks with odd numbers, ISO forms, rounding, flow values."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sediment.functions.scalars import iso_micros
from sediment.operators import identity, shapes
from sediment.operators.cells import cells
from sediment.operators.clock import rank_clocks
from sediment.reports.rounding import rounded
from sediment.schema import YamlError, dump_yaml, parse_yaml


def test_statistics_of_keys(spark, monkeypatch):
    monkeypatch.setattr(identity, "_SPAN_BITS", 6)
    rng = random.Random(3)
    rows = [("all", rng.randrange(5000)) for _ in range(900)] + [(f"k{rng.randrange(40)}", rng.randrange(10**6)) for _ in range(500)] + [("same", 7)] * 50 + [("one", 3), ("late", None), ("k1", None), (None, 5), ("", 5)]
    df = spark.createDataFrame(rows, "key string, t long")
    got = identity.measure(df, [("key",)], F.col("t")).first()
    by = {}
    for k, t in rows:
        if k:
            by.setdefault(k, []).append(t)
    times = {k: sorted(t for t in v if t is not None) for k, v in by.items()}
    gaps = [b - a for v in times.values() for a, b in zip(v, v[1:])]
    spans = [v[-1] - v[0] for v in times.values() if len(v) > 1]
    sizes = sorted(map(len, by.values()))
    assert (got.groups, got.singletons, got.p95_size) == (len(by), sizes.count(1), sizes[int(0.95 * (len(by) - 1))])
    assert got.median_gap_s == pytest.approx(statistics.median(gaps) / 1e6)
    assert got.own_days == pytest.approx(statistics.median(spans) / 86400e6)
    assert got.own_rate == pytest.approx(statistics.median(len(v) / (v[-1] - v[0]) for v in times.values() if len(v) > 1 and v[-1] > v[0]) * 86400e6)
    assert got.mean_size == pytest.approx(sum(sizes) / len(by))


def test_medians(spark):
    rng = random.Random(5)
    groups = {"even": [rng.uniform(0, 1000) for _ in range(100)], "odd": [rng.randrange(5) for _ in range(101)], "zero": [0, 0, 0, 9], "pair": [1e-9, 1e9], "one": [4.5], "wide": [10 ** rng.uniform(-8, 12) for _ in range(333)]}
    df = spark.createDataFrame([(g, "x", float(v), 1) for g, vs in groups.items() for v in vs], "candidate string, of string, v double, k long")
    assert {r.candidate: r.median for r in identity.medians(df).collect()} == {g: pytest.approx(statistics.median(vs)) for g, vs in groups.items()}


def test_a_constant_column_is_spread(spark):
    """One key that holds the whole table: no task sorts more than a small part of its times."""
    df = spark.range(200_000).select(F.lit("all").alias("key"), (F.col("id") * 40_000_000).alias("t"))
    plan = identity.measure(df, [("key",)], F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    got = identity.measure(df, [("key",)], F.col("t")).first()
    assert got.median_gap_s == 40.0 and got.verdict == "bucket"


@pytest.mark.parametrize("first, step", [(0, 1), (20_000, 1), (5, 37)])
def test_clock_sample_by_order(spark, first, step):
    df = spark.range(300).select((F.col("id") * step + first).alias("pos"), F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") < 100, F.col("id")).otherwise(-F.col("id"))).alias("t"), F.lit("x").alias("s"))
    r = rank_clocks(cells(df, "pos", ["t", "s"]), most=100).collect()
    assert [(x.field, x.monotonic, x.parse_rate) for x in r] == [("t", 1.0, 1.0)]


def test_iso_forms(spark):
    texts = ["2024-01-01", "20240101", "2024-01-01T10", "2024-01-01T10:05", "2024-01-01 10:05:06", "2024-01-01T10:05:06.5", "2024-01-01T10:05:06,123456789", "2024-01-01T10:05:06.1234567", "20240101T1000", "20240101T100203", "20240101T10", "2024-01-01T10:00+05", "2024-01-01T10:00:00+0530", "2024-01-01T10:00:00-05:30", "2024-01-01T10Z", "2024-W05-1", "2024W051", "2024-W05", "2024W05", "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W05-8", "2024-02-30", "2024-13-01", "2024-01-01T25:00", "2024-01-01T10:0", "2024-01-01_10:00", "2024-01-01T10:00:00.", "2024-1-1", "hello", "", "12", "2024-01-01T", "2024-01-01T10:0203", "2024-01-01T1002:03"]

    def want(s):
        try:
            t = dt.datetime.fromisoformat(s[:-1] + "+00:00" if s.endswith("Z") else s)
        except ValueError:
            return None
        t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
        return (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)

    got = {r.s: r.t for r in spark.createDataFrame([(s,) for s in texts], "s string").select("s", iso_micros(F.col("s")).alias("t")).collect()}
    assert got == {s: want(s) for s in texts}


def test_rounding():
    assert rounded({"fill_rate": 0.123456, "n": 3, "of": [{"span_days": 1.23456, "other": 0.123456}], "mean_length": 2.25, "score": None}) == {"fill_rate": 0.1235, "n": 3, "of": [{"span_days": 1.235, "other": 0.123456}], "mean_length": 2.2, "score": None}


def test_absorbed_shapes(spark):
    s = spark.createDataFrame([("a b", 3), ("b a b", 2), ("a b c", 1), ("F", 5), (None, 4)], "shape string, n long")
    m = shapes.matches(s, shapes.templates(spark, [{"name": "ab", "template": "aa"}, {"name": "b", "template": "a b"}, {"name": "any", "template": "F"}]))
    assert sorted((r.name, r.rank, r.shape) for r in shapes.absorbed(m).collect()) == [("any", 1, "F")]
    m = shapes.matches(spark.createDataFrame([("to be", 3), ("so to be", 2), ("to be it", 1)], "shape string, n long"), shapes.templates(spark, [{"name": "tb", "template": "to be"}]))
    assert [(r.rank, r.shape, r.n) for r in shapes.absorbed(m).orderBy("rank").collect()] == [(1, "to be", 3), (2, "so to be", 2), (3, "to be it", 1)]


def test_flow_values():
    text = """
a: [x, "y, z", 'it''s', [1, [2.5, -3]], {k: v, "q q": [no, ~]}, a[1], null]
b: {one: 1, two: {three: "3"}, four: }
c: '[not, a, list]'
d: ([A-F0-9]{6,})
e: [a] and b
f: "tab\\tquote\\" end"
g: []
h: {}
i: 1e3
j: .5
k: +7
"""
    assert parse_yaml(text) == {"a": ["x", "y, z", "it's", [1, [2.5, -3]], {"k": "v", "q q": [False, None]}, "a[1]", None], "b": {"one": 1, "two": {"three": "3"}, "four": None}, "c": "[not, a, list]", "d": "([A-F0-9]{6,})", "e": "[a] and b", "f": 'tab\tquote" end', "g": [], "h": {}, "i": 1000.0, "j": 0.5, "k": 7}
    for v in ({"a": [1, "x, y", "[z]", "{q}", "it's", 'say "x"', None, True, "true", "1"]}, {"p": "a: b", "q": "# no", "r": " lead", "s": "", "t": "[a] b"}):
        assert parse_yaml(dump_yaml(v)) == v
    for bad in ("a: [1, {b}]", "a: {x}"):
        with pytest.raises(YamlError):
            parse_yaml(bad)


@pytest.mark.parametrize("heavy", [0, 100, 10**6])
def test_keys_of_any_weight(spark, monkeypatch, heavy):
    """Keys dealt whole and keys spread by time have the same statistics; each row of either is shuffled once or twice, not at every level."""
    monkeypatch.setattr(identity, "_SPAN_BITS", 6)
    monkeypatch.setattr(identity, "_HEAVY", heavy)
    monkeypatch.setattr(identity, "_BUCKETS", 10**6)
    rng = random.Random(4)
    rows = [(1, f"k{rng.randrange(40)}", rng.randrange(3000)) for _ in range(600)] + [(2, rng.choice(["None", "", "x+y", "<HEX1>", None]), 7) for _ in range(200)] + [(rng.randrange(3, 90), "z", rng.choice([None, 10**6, rng.randrange(10**9)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "n int, s string, t long")
    got = {r.candidate: r for r in identity.measure(df, [("n",), ("s",), ("s", "n")], F.col("t")).collect()}
    assert set(got) == {"n", "s", "s+n"}
    for name, key in (("n", lambda n, s: n), ("s", lambda n, s: s), ("s+n", lambda n, s: (s, n))):
        by = {}
        for n, s, t in rows:
            if name == "n" or s not in ("None", "", None):
                by.setdefault(key(n, s), []).append(t)
        times = [sorted(t for t in v if t is not None) for v in by.values()]
        sizes, r = sorted(map(len, by.values())), got[name]
        assert (r.groups, r.singletons, r.p95_size) == (len(by), sizes.count(1), sizes[int(0.95 * (len(by) - 1))])
        assert r.mean_size == pytest.approx(sum(sizes) / len(by))
        assert r.median_gap_s == pytest.approx(statistics.median(b - a for v in times for a, b in zip(v, v[1:])) / 1e6)
        assert r.own_days == pytest.approx(statistics.median(v[-1] - v[0] for v in times if len(v) > 1) / 86400e6)
        assert r.own_rate == pytest.approx(statistics.median(len(v) / (v[-1] - v[0]) for v in times if len(v) > 1 and v[-1] > v[0]) * 86400e6)
        assert r.placeholder_rate == pytest.approx(sum(s == "<HEX1>" for n, s, t in rows if name == "n" or s not in ("None", "", None)) / sum(sizes) if name != "n" else 0)


def test_keys_are_shuffled_once(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("key"), (F.col("id") * 86_400_000_000).alias("t"))
    rows = identity._deal(df, [("key",)], F.col("t"))[0].drop("bucket", "masked")
    plan = identity._whole(rows)._jdf.queryExecution().sparkPlan().toString()
    plan += identity._whole(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "to_json" not in plan
    # what the statistics are read from is kept, so no reader deals the keys again
    whole = identity.measure(df, [("key",)], F.col("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in whole and "lag(" not in whole
