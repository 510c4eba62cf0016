"""Queries by name over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import conformance, identity, profile, project, shapes
from ..operators.cells import cells
from ..operators.clock import rank_clocks
from ..operators.validate import Measurement, validate
from ..scratch import folder
from ..sources import readers, syslog
from ..sources.detect import BSD, RFC5424, Substrate, sniff_syslog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return d.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in d.schema.fields])


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Classes for the words of part names.
CLASSES = [
    {"name": "red thing", "template": "red <NAME>", "retention": "keep"},
    {"name": "small", "template": "small", "retention": "drop"},
    {"name": "bolt", "template": "<NAME> bolt", "retention": "demote"},
    {"name": "small bolt", "template": "small <X> bolt", "retention": "keep"},
    {"name": "widget", "template": "NAME widget SIZE", "retention": "keep-extended"},
]
_CLASS_SQL = "(VALUES (0,'red thing',' red ',1,2),(1,'small',' small ',1,1),(2,'bolt',' bolt ',1,2),(3,'small bolt',' small (?:.* )?bolt ',2,3),(4,'widget',' widget ',1,3)) AS c(place,name,pattern,specificity,raw_words)"
_PLACEHOLDER_SQL = S.PLACEHOLDER.replace("'", "''")


def _cells_sql(name: str, pos: str, fields: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {pos} AS pos, '{f}' AS field, CAST({f} AS VARCHAR) AS sval FROM {name}" for f in fields)


def _profile_sql(name: str, pos: str, fields: list[str]) -> str:
    return f"""WITH cells AS ({_cells_sql(name, pos, fields)}) SELECT field, count(*) AS present,
count(*) FILTER (sval <> '') AS non_null, count(DISTINCT CASE WHEN sval <> '' THEN sval END) AS "distinct",
round(count(*) FILTER (sval <> '') / count(*), 6) AS fill_rate,
round(coalesce(count(DISTINCT CASE WHEN sval <> '' THEN sval END) / nullif(count(*) FILTER (sval <> ''), 0), 0), 6) AS cardinality,
round(coalesce(sum(length(sval)) FILTER (sval <> '') / nullif(count(*) FILTER (sval <> ''), 0), 0), 6) AS mean_length,
coalesce(max(length(sval)) FILTER (sval <> ''), 0) AS max_length,
round(coalesce(count(*) FILTER (regexp_matches(sval, '{_PLACEHOLDER_SQL}')) / nullif(count(*) FILTER (sval <> ''), 0), 0), 6) AS placeholder_rate
FROM cells GROUP BY field"""


def _profiled(c: DataFrame) -> DataFrame:
    return profile.profile_fields(c).select("field", "present", "non_null", "distinct", *r6("fill_rate", "cardinality", "mean_length"), "max_length", *r6("placeholder_rate"))


@query(_profile_sql("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def profile_fields_customer(spark, sf_dir):
    """A1, A2, A4"""
    return _profiled(cells(table(spark, sf_dir, "customer"), "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))


@query(_profile_sql("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
def profile_fields_orders(spark, sf_dir):
    return _profiled(cells(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


@query(_profile_sql("documents", "doc_id", ["text", "lang", "source"]))
def placeholder_rate(spark, sf_dir):
    """PF3, PF7"""
    return _profiled(cells(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"]))


@query("""SELECT * FROM (VALUES ('p_partkey','int'),('p_name','str'),('p_size','int'),('p_retailprice','float')) AS t(field, kind)""")
def value_kind(spark, sf_dir):
    """F1, A3"""
    return profile.dominant_kinds(cells(table(spark, sf_dir, "part"), "p_partkey", ["p_partkey", "p_name", "p_size", "p_retailprice"]))


_PAGES = ["page_id", "url", "html"]


@query("""WITH cells AS (SELECT event_id AS pos, 'event_id' AS field, CAST(event_id AS VARCHAR) AS sval FROM events UNION ALL SELECT event_id, 'event_type', event_type FROM events UNION ALL SELECT event_id, 'props', props FROM events),
v AS (SELECT field, trim(sval) AS s FROM cells WHERE sval <> '' QUALIFY row_number() OVER (PARTITION BY field ORDER BY pos) <= 500)
SELECT field, CASE WHEN bool_and(regexp_matches(s, '^[0-9]+$')) THEN 'integer' WHEN bool_and(regexp_matches(s, '^[0-9a-fA-F]{6,}$')) THEN 'hex' WHEN bool_and(NOT contains(s, ' ')) THEN 'token' WHEN avg(length(s)) > 40 THEN 'free-text' ELSE 'token' END AS shape FROM v GROUP BY field""")
def value_shape(spark, sf_dir):
    """F2"""
    return profile.value_shapes(cells(table(spark, sf_dir, "events"), "event_id", ["event_id", "event_type", "props"]))


@query("""SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) AS us, CAST(NULL AS BIGINT) AS small FROM events""")
def clock_epoch_parse(spark, sf_dir):
    """F3, with seconds, milliseconds and microseconds written as text"""
    e = table(spark, sf_dir, "events").withColumn("u", F.unix_micros("ts"))
    text = lambda d: F.floor(F.col("u") / d).cast("string")
    return e.select("event_id", S.epoch_micros(text(1_000_000)).alias("s"), S.epoch_micros(text(1000)).alias("ms"), S.epoch_micros(F.col("u").cast("string")).alias("us"), S.epoch_micros(F.col("event_id").cast("string")).alias("small"))


@query("""WITH t AS (SELECT event_id, date_trunc('second', ts) AS s FROM events) SELECT event_id, epoch_us(s) AS iso, epoch_us(s) AS iso_zone, epoch_us(date_trunc('day', s)) AS iso_day, epoch_us(s) AS dmy, epoch_us(s) AS common, epoch_us(try_strptime('1900' || strftime(s, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS bsd, CAST(NULL AS BIGINT) AS none FROM t""")
def clock_iso_dmy_common(spark, sf_dir):
    """F4 to F8"""
    e = table(spark, sf_dir, "events").withColumn("s", F.date_trunc("second", "ts"))
    f = lambda form: F.date_format("s", form)
    return e.select(
        "event_id",
        S.clock_micros(f("yyyy-MM-dd HH:mm:ss")).alias("iso"),
        S.clock_micros(F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("iso_zone"),
        S.clock_micros(f("yyyy-MM-dd")).alias("iso_day"),
        S.clock_micros(f("dd/MM/yyyy HH:mm:ss")).alias("dmy"),
        S.clock_micros(F.concat(f("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))).alias("common"),
        S.clock_micros(f("MMM d HH:mm:ss")).alias("bsd"),
        S.clock_micros(F.col("event_type")).alias("none"),
    )


@query("""WITH s AS (SELECT event_id AS pos, ts FROM events ORDER BY event_id LIMIT 20000), d AS (SELECT ts >= lag(ts) OVER (ORDER BY pos) AS up, ts FROM s)
SELECT 'ts' AS field, 'iso8601' AS strategy, 1.0::DOUBLE AS parse_rate, round(coalesce(avg(up::INT), 1), 6) AS monotonic, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, round(0.5 + 0.5 * coalesce(avg(up::INT), 1), 6) AS score, 1 AS rank FROM d""")
def clock_rank(spark, sf_dir):
    """PF4, A13, W1, F9, T1"""
    c = rank_clocks(cells(table(spark, sf_dir, "events"), "event_id", ["ts", "event_type", "user_id"]))
    return c.select("field", "strategy", *r6("parse_rate", "monotonic"), "first", "last", *r6("score"), "rank")


def _identity_sql(name: str, keys: dict[str, str], clock: str) -> str:
    union = " UNION ALL ".join(f"SELECT '{k}' AS candidate, {e} AS key, epoch_us({clock}) AS t FROM {name}" for k, e in keys.items())
    return f"""WITH r AS (SELECT * FROM ({union}) WHERE key IS NOT NULL), g AS (SELECT candidate, key, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM r GROUP BY ALL),
a AS (SELECT candidate, count(*) AS groups, count(*) FILTER (n = 1) AS singletons, sum(n) / count(*) AS mean_size, (max(t1) - min(t0)) / 86400e6 AS span_days, sum(n) AS rows,
median(CASE WHEN n >= 2 THEN (t1 - t0) / 86400e6 END) AS own_days, median(CASE WHEN n >= 2 AND t1 > t0 THEN n / ((t1 - t0) / 86400e6) END) AS own_rate, list_sort(list(n))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95_size FROM g GROUP BY candidate),
gap AS (SELECT candidate, median(d) AS median_gap_s FROM (SELECT candidate, (t - lag(t) OVER (PARTITION BY candidate, key ORDER BY t)) / 1e6 AS d FROM r) GROUP BY candidate)
SELECT candidate, groups, singletons, p95_size, round(mean_size, 6) AS mean_size, round(span_days, 6) AS span_days, round(own_days, 6) AS own_days, round(own_rate, 4) AS own_rate, round(median_gap_s, 4) AS median_gap_s, round(CASE WHEN span_days > 0 THEN rows / span_days END, 4) AS rate_per_day,
CASE WHEN singletons / groups > 0.95 THEN 'noise' WHEN own_days IS NOT NULL AND span_days > 0 THEN CASE WHEN own_days / span_days < 0.05 AND mean_size < 1000 THEN 'session' WHEN mean_size >= 50 THEN 'bucket' ELSE 'entity' END WHEN mean_size >= 50 THEN 'bucket' WHEN mean_size >= 2 THEN 'entity' ELSE 'noise' END AS verdict FROM a JOIN gap USING (candidate)"""


def _identity(records: DataFrame, keys: list[tuple[str, ...]], clock: str) -> DataFrame:
    m = identity.measure(records, keys, F.unix_micros(clock))
    return m.select("candidate", "groups", "singletons", "p95_size", *r6("mean_size", "span_days", "own_days"), *[F.round(c, 4).alias(c) for c in ("own_rate", "median_gap_s", "rate_per_day")], "verdict")


def _singles(names: list[str]) -> list[tuple[str, ...]]:
    return [(n,) for n in names]


_EVENT_KEYS = ["event_id", "user_id", "event_type", "props"]


@query(_identity_sql("events", {k: f"CAST({k} AS VARCHAR)" for k in _EVENT_KEYS}, "ts"))
def identity_singles_events(spark, sf_dir):
    """A6 to A12 and the verdict"""
    return _identity(table(spark, sf_dir, "events"), _singles(_EVENT_KEYS), "ts")


_ORDER_KEYS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(_identity_sql("orders", {k: f"CAST({k} AS VARCHAR)" for k in _ORDER_KEYS}, "o_orderdate"))
def identity_singles_orders(spark, sf_dir):
    return _identity(table(spark, sf_dir, "orders"), _singles(_ORDER_KEYS), "o_orderdate")


@query(_identity_sql("lineitem", {"l_linenumber+l_orderkey": "l_linenumber || '+' || l_orderkey", "l_orderkey+l_suppkey": "l_orderkey || '+' || l_suppkey", "l_partkey+l_suppkey": "l_partkey || '+' || l_suppkey"}, "l_shipdate"))
def identity_pairs(spark, sf_dir):
    """J4"""
    return _identity(table(spark, sf_dir, "lineitem"), [("l_linenumber", "l_orderkey"), ("l_orderkey", "l_suppkey"), ("l_partkey", "l_suppkey")], "l_shipdate")


@query(_identity_sql("events", {"hour": "strftime(ts, '%Y-%m-%d %H')"}, "ts"))
def identity_session(spark, sf_dir):
    """Rule 5: events of an hour are a burst"""
    return _identity(table(spark, sf_dir, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")), [("hour",)], "ts")


_FIRST_SQL = _identity_sql("(SELECT * FROM events ORDER BY event_id LIMIT 1000)", {k: f"CAST({k} AS VARCHAR)" for k in _EVENT_KEYS}, "ts").replace("> 0.95 THEN 'noise'", "> 0.95 THEN 'undetermined'")


@query(f"SELECT candidate, groups, verdict FROM ({_FIRST_SQL})")
def identity_partial(spark, sf_dir):
    """T7 and rule 4: with a scan that hit its limit, keys seen once are undetermined"""
    first = table(spark, sf_dir, "events").orderBy("event_id").limit(1000)
    return identity.measure(first, _singles(_EVENT_KEYS), F.unix_micros("ts"), partial=True).select("candidate", "groups", "verdict")


_TEXT_FIELDS = ("c_name", "c_mktsegment")
_RANK_SQL = " UNION ALL ".join(f"SELECT c_custkey AS pos, '{f}' AS field, {f} AS sval FROM customer" for f in _TEXT_FIELDS)


@query(f"""WITH v AS (SELECT * FROM ({_RANK_SQL}) WHERE sval <> '' QUALIFY row_number() OVER (PARTITION BY field ORDER BY pos) <= 400),
s AS (SELECT field, count(DISTINCT sval) AS "distinct", count(*) AS n FROM v GROUP BY field),
w AS (SELECT field, word, count(*) AS k FROM (SELECT field, unnest(string_split_regex(lower(sval), '[^a-z0-9]+')) AS word FROM v) WHERE word <> '' GROUP BY ALL),
c AS (SELECT field, "distinct", round(sum(if(k > 1, k, 0)) / sum(k), 6) AS reuse, round(sum(k) / any_value(n), 6) AS mean_words FROM w JOIN s USING (field) GROUP BY field, "distinct")
SELECT *, row_number() OVER (ORDER BY "distinct" <= 16, -reuse * mean_words, field) AS rank FROM c""")
def content_rank(spark, sf_dir):
    """A15, PF5, T4"""
    r = profile.content_rank(cells(table(spark, sf_dir, "customer"), "c_custkey"))
    return r.select("field", "distinct", *r6("reuse", "mean_words"), "rank")


_LINES = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"""


#: White space of any script, as a class in RE2.
_BLANK_SQL = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]"


def _mask_sql(c: str) -> str:
    """RE2 knows word edges of ASCII only: spaces, letters and signs beyond it become ' ', '_' and '~', one for one."""
    c = f"regexp_replace({c}, '[\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    for m in S.MASKS:
        c = f"regexp_replace({c}, '{m}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


_WORDS_SQL = "[" + ",".join(f"'{w}'" for w in S.FUNCTION_WORDS) + "]"
_SKELETON_SQL = f"""l AS (SELECT line, regexp_replace(line, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g') AS s FROM {_LINES}),
m AS (SELECT line, s, {_mask_sql('s')} AS w FROM l),
k AS (SELECT line, CASE WHEN s <> '' AND length(s) <= 480 AND w <> '' AND len(string_split(w, ' ')) <= 14 AND len(list_filter(string_split(w, ' '), lambda x: list_contains({_WORDS_SQL}, lower(x)))) < 2 THEN substr(w, 1, 120) END AS shape FROM m)"""


def _all_lines(spark, sf_dir) -> DataFrame:
    """Every line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"WITH {_SKELETON_SQL} SELECT shape, count(*) AS n FROM k WHERE line <> '' GROUP BY shape")
def shape_counts(spark, sf_dir):
    """F10, F11, A14, T5"""
    return shapes.shape_counts(_all_lines(spark, sf_dir), "line")


@query(f"WITH {_SKELETON_SQL} SELECT count(*) AS lines, count(*) FILTER (shape IS NULL AND line <> '') AS untemplatable, count(*) FILTER (line = '') AS empty, count(DISTINCT shape) AS shapes FROM k")
def untemplatable_share(spark, sf_dir):
    line = F.col("line")
    shape = F.when(S.non_empty(line), S.skeleton(line))
    x = _all_lines(spark, sf_dir).select("line", shape.alias("shape"))
    return x.agg(F.count("*").alias("lines"), F.count_if(F.col("shape").isNull() & (line != "")).alias("untemplatable"), F.count_if(line == "").alias("empty"), F.countDistinct("shape").alias("shapes"))


_PART = "s AS (SELECT p_name AS shape, count(*) AS n FROM part GROUP BY 1)"
_MATCH = f"{_PART}, m AS (SELECT * FROM s JOIN {_CLASS_SQL} ON regexp_matches(' ' || shape || ' ', pattern))"


def _part_matches(spark, sf_dir):
    s = shapes.shape_counts(table(spark, sf_dir, "part"), "p_name")
    return s, shapes.matches(s, shapes.templates(spark, CLASSES))


@query(f"WITH {_MATCH} SELECT shape, name, n FROM m")
def template_match(spark, sf_dir):
    """J1, F12 to F14"""
    return _part_matches(spark, sf_dir)[1].select("shape", "name", "n")


def _owner_query(rule: str, order: str):
    @query(f"WITH {_MATCH} SELECT shape, n, name FROM m QUALIFY row_number() OVER (PARTITION BY shape ORDER BY {order}) = 1")
    def owner(spark, sf_dir):
        return shapes.owners(_part_matches(spark, sf_dir)[1], rule).select("shape", "n", "name")

    for d in (QUERIES, ORACLE):
        d[f"owner_{rule}"] = d.pop("owner")


for _rule, _order in (("specific", "specificity DESC, place"), ("longest", "raw_words DESC, place"), ("declared", "place")):
    _owner_query(_rule, _order)

_OWN = f"{_MATCH}, o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY shape ORDER BY specificity DESC, place) = 1)"


@query(f"WITH {_OWN} SELECT (SELECT sum(n) FROM o)::BIGINT AS covered, (SELECT sum(n) FROM s)::BIGINT AS total, (SELECT count(*) FROM s WHERE shape NOT IN (SELECT shape FROM o)) AS residue_shapes")
def class_coverage(spark, sf_dir):
    """A16, A17, J5"""
    s, m = _part_matches(spark, sf_dir)
    own = shapes.owners(m)
    rest = shapes.residue(s, own).agg(F.count("*").alias("residue_shapes"))
    return own.agg(F.sum("n").alias("covered")).crossJoin(s.agg(F.sum("n").alias("total"))).crossJoin(rest)


@query(f"WITH {_OWN} SELECT shape, n FROM s WHERE shape NOT IN (SELECT shape FROM o) ORDER BY n DESC, shape LIMIT 8")
def residue_topk(spark, sf_dir):
    s, m = _part_matches(spark, sf_dir)
    return shapes.residue(s, shapes.owners(m)).orderBy(F.desc("n"), "shape").limit(8)


@query(f"WITH {_OWN} SELECT p_partkey, name AS class FROM part LEFT JOIN o ON p_name = shape")
def classify_records(spark, sf_dir):
    """J2"""
    m = _part_matches(spark, sf_dir)[1]
    return shapes.classify(table(spark, sf_dir, "part"), "p_name", shapes.owners(m)).select("p_partkey", "class")


@query(f"WITH {_OWN} SELECT count(*) AS seen, count(name) AS classified, count(*) - count(name) AS unclassified FROM part LEFT JOIN o ON p_name = shape")
def classifier_report(spark, sf_dir):
    """A19"""
    m = _part_matches(spark, sf_dir)[1]
    c = shapes.classify(table(spark, sf_dir, "part"), "p_name", shapes.owners(m))
    return c.agg(F.count("*").alias("seen"), F.count("class").alias("classified"), F.count_if(F.col("class").isNull()).alias("unclassified"))


@query("SELECT page_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS ids FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([A-Za-z]+)', 1) AS ids FROM pages)")
def message_ids(spark, sf_dir):
    """distinct, in order of appearance"""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(S.message_ids(F.col("html"), 'href="/([A-Za-z]+)'), ",").alias("ids"))


@query("""WITH i AS (SELECT list_distinct(regexp_extract_all(props, '"k": ([0-9]+)', 1)) AS ids FROM events) SELECT count(*) AS records, count(*) FILTER (len(ids) > 0) AS records_with_id, count(*) FILTER (len(ids) > 1) AS records_with_several, (SELECT count(DISTINCT x) FROM (SELECT unnest(ids) AS x FROM i)) AS distinct_ids FROM i""")
def message_id_stats(spark, sf_dir):
    """A18, W6"""
    return project.message_id_stats(table(spark, sf_dir, "events"), "props", '"k": ([0-9]+)')


@query("""SELECT regexp_extract(props, '"k": ([0-9]+)', 1) AS id, count(*) AS n, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY 1""")
def message_lifecycles(spark, sf_dir):
    """Extension"""
    return project.message_lifecycles(table(spark, sf_dir, "events"), "props", '"k": ([0-9]+)', F.unix_micros("ts"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS time, 'exact' AS precision, user_id || ':' || event_type AS canonical_name, props AS body_text, regexp_extract(props, '"k": ([0-9]+)', 1) AS message_id, 'app' AS stream FROM events""")
def project_events(spark, sf_dir):
    """F16 to F18 and the event struct, flattened"""
    schema = {"identity_key": ["user_id", "event_type"], "time_field": "ts", "stream": "app", "record_layers": {"envelope": [{"path": "ts", "role": "context"}, {"path": "user_id", "role": "identity"}], "payload": [{"path": "props", "role": "content"}]}, "classes": [], "message_key": {"name": "k", "field": "props", "pattern": '"k": ([0-9]+)'}}
    e = project.project(schema, table(spark, sf_dir, "events"), "event_id")
    return e.select(F.col("index").alias("event_id"), "wall.time", "wall.precision", "identity.canonical_name", "content.body_text", F.get("message.ids", F.lit(0)).alias("message_id"), F.col("stream_hint").alias("stream"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, 'h' || (user_id % 7) AS host, event_type AS ident, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END AS pid, props AS message FROM events""")
def syslog_bsd_parse(spark, sf_dir):
    """SRC12, SRC16"""
    e = table(spark, sf_dir, "events")
    pid = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("["), F.col("user_id"), F.lit("]"))).otherwise("")
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    line = F.concat(F.date_format("ts", "MMM"), F.lit(" "), day, F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" h"), F.col("user_id") % 7, F.lit(" "), F.col("event_type"), pid, F.lit(": "), F.col("props"))
    p = syslog.parse_bsd(line, F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return e.select("event_id", p.alias("p")).select("event_id", "p.stamp", "p.host", "p.ident", "p.pid", "p.message")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'h1' AS host, event_type AS ident, user_id::VARCHAR AS pid, props AS message FROM events""")
def syslog_5424_parse(spark, sf_dir):
    """SRC13"""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("<134>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" h1 "), F.col("event_type"), F.lit(" "), F.col("user_id"), F.lit(' ID47 [a b="c"] '), F.col("props"))
    return e.select("event_id", syslog.parse_rfc5424(line).alias("p")).select("event_id", "p.stamp", "p.host", "p.ident", "p.pid", "p.message")


@query("""WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
x AS (SELECT doc_id, CASE WHEN regexp_full_match(line, '[\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]*') THEN NULL ELSE line END AS line FROM l) SELECT doc_id, count(line) AS lines FROM x GROUP BY doc_id""")
def continuation_lines(spark, sf_dir):
    """SRC14, W5: every line after a document's first joins it; lines joined and left over add up"""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rec, bad = syslog.join_continuations(d, F.col("pos") == 0)
    a = rec.groupBy("file").agg(F.sum(F.col("joined") + 1).alias("a"))
    b = bad.groupBy("file").agg(F.count("*").alias("b"))
    all_ = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"))
    return all_.join(a, "file", "left").join(b, "file", "left").select(F.col("file").alias("doc_id"), (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("lines"))


_ITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
_ITEM_SQL = _identity_sql("lineitem", {k: f"CAST({k} AS VARCHAR)" for k in _ITEM_KEYS} | {"l_orderkey+l_suppkey": "l_orderkey || '+' || l_suppkey"}, "l_shipdate")
#: Keys a schema may claim: a field, a pair in the other order, a field that isn't measured.
CLAIMS = ["l_orderkey", "l_suppkey+l_orderkey", "l_suppkey", "l_orderkey+l_comment"]


@query(_identity_sql("lineitem", {k: f"CAST({k} AS VARCHAR)" for k in _ITEM_KEYS}, "l_shipdate"))
def identity_singles_lineitem(spark, sf_dir):
    return _identity(table(spark, sf_dir, "lineitem"), _singles(_ITEM_KEYS), "l_shipdate")


@query(f"""WITH q AS ({_ITEM_SQL}), c AS (SELECT unnest({CLAIMS}) AS claimed)
SELECT claimed, verdict, coalesce(verdict IN ('session', 'entity'), false) AS holds FROM c LEFT JOIN q ON list_sort(string_split(claimed, '+')) = list_sort(string_split(candidate, '+'))""")
def identity_claim_match(spark, sf_dir):
    """J3, V3"""
    m = identity.measure(table(spark, sf_dir, "lineitem"), [*_singles(_ITEM_KEYS), ("l_orderkey", "l_suppkey")], F.unix_micros("l_shipdate"))
    return identity.claims(m, spark.createDataFrame([(c,) for c in CLAIMS], "claimed string"))


@query(f"""WITH {_OWN}, r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_name END AS content FROM part)
SELECT p_partkey, CASE WHEN content <> '' THEN name ELSE 'silent' END AS class FROM r LEFT JOIN o ON content = shape""")
def empty_class(spark, sf_dir):
    """V5, A16: names of a third of the parts left empty and of a third left null are the empty class's"""
    m = _part_matches(spark, sf_dir)[1]
    third = F.col("p_size") % 3
    r = table(spark, sf_dir, "part").select("p_partkey", F.when(third == 0, "").when(third == 1, F.col("p_name")).alias("content"))
    return shapes.classify(r, "content", shapes.owners(m), "silent").select("p_partkey", "class")


@query("""WITH e AS (SELECT event_id, ts + to_days(CAST(user_id % 366 AS INTEGER)) AS t FROM events),
c AS (SELECT event_id, try_strptime(y || strftime(t, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS t FROM e, range(2023, 2026) AS r(y)),
g AS (SELECT *, abs(epoch_us(t) - epoch_us(TIMESTAMP '2024-02-01 00:00:00')) AS gap FROM c WHERE t IS NOT NULL),
o AS (SELECT *, lead(gap) OVER w AS following, row_number() OVER w AS at_ FROM g WINDOW w AS (PARTITION BY event_id ORDER BY gap, t))
SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') AS stamp, year(t) <> 2024 AS wrapped, coalesce(gap > 0 AND following < 1.5 * gap, false) AS ambiguous FROM o WHERE at_ = 1""")
def syslog_year(spark, sf_dir):
    """SRC16: stamps over a year, against one reference time"""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.make_dt_interval((F.col("user_id") % 366).cast("int"))).alias("t"))
    y = syslog.nearest_year(F.date_format("t", "MMM"), F.date_format("t", "d"), F.date_format("t", "HH:mm:ss"), F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return e.select("event_id", y.alias("y")).select("event_id", "y.stamp", "y.wrapped", "y.ambiguous")


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT *, sum(if(pos = 0 OR regexp_matches(line, '^[A-Z]'), 1, 0)) OVER (PARTITION BY doc_id ORDER BY pos) AS rec FROM l WHERE NOT regexp_full_match(line, '[\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]*')),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rec ORDER BY pos) - 1 AS k FROM s)
SELECT doc_id, min(pos) AS pos, count(*) - 1 AS joined, md5(string_agg(if(k > 0, regexp_replace(line, '^[\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]+|[\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]+$', '', 'g'), line), chr(10) ORDER BY pos)) AS digest FROM n WHERE rec > 0 AND k <= 200 GROUP BY doc_id, rec""")
def continuation_join(spark, sf_dir):
    """SRC14, J8, W5: lines that don't begin with a capital letter join the record before"""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rec, _ = syslog.join_continuations(d, (F.col("pos") == 0) | F.col("line").rlike("^[A-Z]"))
    return rec.select(F.col("file").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.col("joined").cast("long").alias("joined"), F.md5("line").alias("digest"))


_BSD_SQL, _5424_SQL = (p.replace("'", "''") for p in (BSD, RFC5424))


@query(f"""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events QUALIFY i <= 45),
t AS (SELECT user_id, i, CASE WHEN kind = 'b' THEN 'Oct  3 03:27:45 mx1 app[' || event_id || ']: said' WHEN kind = 'r' THEN '<134>1 2026-09-27T03:27:45Z h app ' || event_id || ' - - said' WHEN kind = ' ' THEN '  ' ELSE '  at line ' || event_id END AS line
FROM (SELECT *, CASE user_id % 8 WHEN 0 THEN 'b' WHEN 1 THEN 'r' WHEN 2 THEN if(event_id % 2 = 0, 'b', 'r') WHEN 3 THEN if(i = 1, 'p', 'b') WHEN 4 THEN if(i < 4, 'p', 'b') WHEN 5 THEN if(i % 3 = 1, 'b', 'p') WHEN 6 THEN if(i % 4 = 0, ' ', 'r') ELSE 'p' END AS kind FROM l)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM t WHERE trim(line) <> ''),
m AS (SELECT user_id, k, regexp_matches(line, '{_BSD_SQL}') AS b, regexp_matches(line, '{_5424_SQL}') AS r FROM n WHERE k <= 40),
o AS (SELECT *, NOT b AND NOT r AND NOT coalesce(bool_or(b OR r) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS other FROM m),
v AS (SELECT user_id, count(*) FILTER (b) AS b, count(*) FILTER (r) AS r, count(*) FILTER (b OR r OR other) AS t FROM o GROUP BY user_id)
SELECT user_id, CASE WHEN b > 0 AND r = 0 AND if(t < 3, b = t, b >= 0.8 * t) THEN 'bsd' WHEN r > 0 AND b = 0 AND if(t < 3, r = t, r >= 0.8 * t) THEN 'rfc5424' END AS dialect FROM v""")
def sniff_dialect(spark, sf_dir):
    """SRC10, SRC11: heads of 45 lines, of eight mixes of records, prose, continuations and blank lines"""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("i")).filter("i <= 45")
    kind = F.expr("CASE user_id % 8 WHEN 0 THEN 'b' WHEN 1 THEN 'r' WHEN 2 THEN if(event_id % 2 = 0, 'b', 'r') WHEN 3 THEN if(i = 1, 'p', 'b') WHEN 4 THEN if(i < 4, 'p', 'b') WHEN 5 THEN if(i % 3 = 1, 'b', 'p') WHEN 6 THEN if(i % 4 = 0, ' ', 'r') ELSE 'p' END")
    n = F.col("event_id").cast("string")
    line = F.when(kind == "b", F.concat(F.lit("Oct  3 03:27:45 mx1 app["), n, F.lit("]: said"))).when(kind == "r", F.concat(F.lit("<134>1 2026-09-27T03:27:45Z h app "), n, F.lit(" - - said"))).when(kind == " ", "  ").otherwise(F.concat(F.lit("  at line "), n))
    heads = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("head"))
    sniff = F.pandas_udf(lambda h: h.map(sniff_syslog), "string")
    return heads.select("user_id", sniff("head").alias("dialect"))


#: Two schemas of events with the hour of each: one that is true of them, one that is wrong in every claim.
_TYPES = ["click", "error", "purchase", "signup", "view"]
TRUE_SCHEMA = {
    "identity_key": "hour",
    "time_field": "ts",
    "message_key": {"name": "k", "field": "props", "pattern": '"k": ([0-9]+)'},
    "record_layers": {"envelope": [{"path": "ts", "role": "context"}, {"path": "hour", "role": "identity"}, {"path": "user_id", "role": "context"}], "payload": [{"path": "event_type", "role": "content"}]},
    "classes": [{"name": t, "template": t, "retention": "keep"} for t in _TYPES],
}
FALSE_SCHEMA = {
    "identity_key": "user_id",
    "time_field": "props",
    "message_key": {"name": "k", "field": "props", "pattern": "nothing ([0-9]+) like it"},
    "record_layers": {"envelope": [{"path": "user_id", "role": "identity"}, {"path": "session", "role": "context"}], "payload": [{"path": "event_type", "role": "content"}]},
    "classes": [{"name": "click", "template": "click", "retention": "keep"}, {"name": "phantom", "template": "zzqx wvut never logged", "retention": "keep"}],
}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.date_format("ts", "'h'yyyy-MM-dd HH").alias("hour"), "user_id", "event_type", "props")


_EVENT_VERDICTS = "i AS (SELECT candidate, verdict FROM (" + _identity_sql("events", {"hour": "strftime(ts, '%Y-%m-%d %H')", "user_id": "CAST(user_id AS VARCHAR)", "event_type": "event_type", "props": "props"}, "ts") + "))"
_EVENT_FACTS = f"""{_EVENT_VERDICTS}, k AS (SELECT unnest(['pos', 'ts', 'hour', 'user_id', 'event_type', 'props']) AS name),
c AS (SELECT avg((ts >= before)::INT) >= 0.95 AS up FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM (SELECT * FROM events ORDER BY event_id LIMIT 20000)) WHERE before IS NOT NULL)"""


def _claims_sql(schema: dict) -> str:
    """Each claim of a schema, measured on events."""
    classes = "[" + ",".join(f"'{c['template']}'" for c in schema["classes"]) + "]"
    paths = "[" + ",".join(f"'{f['path']}'" for part in schema["record_layers"].values() for f in part) + "]"
    pattern = schema["message_key"]["pattern"].replace("'", "''")
    matched = "contains(' ' || event_type || ' ', ' ' || t || ' ')"
    return f"""SELECT unnest([
{{'predicate': 'fields_present', 'passed': (SELECT bool_and(p IN (SELECT name FROM k)) FROM (SELECT unnest({paths}) AS p))}},
{{'predicate': 'declared_fields_unmasked', 'passed': (SELECT avg(regexp_matches(v, '{_PLACEHOLDER_SQL}')::INT) <= 0.9 FROM (SELECT {"strftime(ts, '%Y-%m-%d %H')" if schema["identity_key"] == "hour" else "CAST(user_id AS VARCHAR)"} AS v FROM events))}},
{{'predicate': 'identity_key', 'passed': (SELECT verdict IN ('session', 'entity') FROM i WHERE candidate = '{schema["identity_key"]}')}},
{{'predicate': 'message_key', 'passed': (SELECT count(*) FILTER (regexp_matches(props, '{pattern}')) > 0 FROM events)}},
{{'predicate': 'classes_resolve', 'passed': (SELECT bool_and(t IN (SELECT t FROM events, (SELECT unnest({classes}) AS t) WHERE {matched})) FROM (SELECT unnest({classes}) AS t))}},
{{'predicate': 'every_record_classed', 'passed': (SELECT count(*) FILTER (EXISTS (SELECT 1 FROM (SELECT unnest({classes}) AS t) WHERE {matched})) >= 0.9 * count(*) FROM events)}},
{{'predicate': 'clock_resolvable', 'passed': (SELECT up AND '{schema["time_field"]}' = 'ts' FROM c)}},
{{'predicate': 'deterministic', 'passed': true}}], recursive := true)"""


@query(f"WITH {_EVENT_FACTS} SELECT 'true' AS schema, * FROM ({_claims_sql(TRUE_SCHEMA)}) UNION ALL SELECT 'false', * FROM ({_claims_sql(FALSE_SCHEMA)})")
def validate_predicates(spark, sf_dir):
    """V1 to V8, A16, A21: every claim of a schema that holds and of one that doesn't"""
    m = Measurement(hourly(spark, sf_dir))
    rows = [(name, r.name, r.passed) for name, schema in (("true", TRUE_SCHEMA), ("false", FALSE_SCHEMA)) for r in validate(schema, m).results]
    m.close()
    return spark.createDataFrame(rows, "schema string, predicate string, passed boolean")


@query(f"""WITH {_EVENT_FACTS}, f(fixture, target, wrong) AS (VALUES
('field-does-not-exist', 'fields_present', 'no_such_field' NOT IN (SELECT name FROM k)),
('identity-key-is-a-bucket', 'identity_key', (SELECT verdict = 'bucket' FROM i WHERE candidate = 'user_id')),
('class-matches-nothing', 'classes_resolve', (SELECT count(*) = 0 FROM events WHERE regexp_matches(event_type, 'zzqx.*wvut.*never.*logged'))),
('clock-is-not-a-clock', 'clock_resolvable', 'no_such_clock' NOT IN (SELECT name FROM k)),
('message-pattern-matches-nothing', 'message_key', (SELECT count(*) = 0 FROM events WHERE contains(props, 'never-in-any-log-7f3a'))),
('retention-is-unknown', 'classes_resolve', 'keep-extened' NOT IN ('keep', 'keep-extended', 'demote', 'drop')),
('identity-key-is-masked', 'identity_key', 'no_such_masked_field' NOT IN (SELECT candidate FROM i)),
('no-identity-key', 'identity_key', true))
SELECT fixture, target, if(wrong, 'rejected-as-required', 'PASSED-BUT-SHOULD-FAIL') AS outcome FROM f""")
def conformance_matrix(spark, sf_dir):
    """N1 to N8, PF8, PF9, J6, J7: schemas that are wrong in one way, of a schema that is true of events"""
    m = Measurement(hourly(spark, sf_dir))
    made = conformance.fixtures(TRUE_SCHEMA, conformance.measure_facts(TRUE_SCHEMA, m, "ts"))
    rows = [(f["name"], f["target"], conformance.judge(f["schema"], f["target"], f["says"], m, None)) for f in made]
    m.close()
    return spark.createDataFrame(rows, "fixture string, target string, outcome string")


@query(f"WITH {_MATCH} SELECT name, row_number() OVER (PARTITION BY place ORDER BY length(shape), shape) AS rank, shape, n FROM m")
def absorbed_shapes(spark, sf_dir):
    """T6: all shapes that each class absorbs, in order"""
    return shapes.absorbed(_part_matches(spark, sf_dir)[1]).select("name", "rank", "shape", "n")


@query("SELECT p_name AS shape, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY p_name ORDER BY rank LIMIT 60")
def shape_topk(spark, sf_dir):
    """T5: the 60 most frequent shapes, in order"""
    from pyspark.sql import Window

    top = shapes.shape_counts(table(spark, sf_dir, "part"), "p_name").filter("shape is not null").orderBy(F.desc("n"), "shape").limit(60)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "shape")))


_SHAPED = {
    "email": ("concat('u', user_id, '@host', event_id % 9, '.org')", "'u' || user_id || '@host' || event_id % 9 || '.org'"),
    "ipv4": ("concat('10.', user_id % 256, '.', event_id % 256, '.7')", "'10.' || user_id % 256 || '.' || event_id % 256 || '.7'"),
    "uuid": ("concat(lpad(hex(event_id), 8, '0'), '-12ab-', event_id)", "lpad(upper(to_hex(event_id)), 8, '0') || '-12ab-' || event_id"),
    "path": ("concat(' /var/log/', event_type)", "' /var/log/' || event_type"),
    "code": ("upper(concat('QX ', event_type))", "upper('QX ' || event_type)"),
    "number": ("concat('', event_id)", "'' || event_id"),
    "digest": ("concat('abcdef', event_id)", "'abcdef' || event_id"),
    "said": ("concat('a long text of several words about ', event_type, ' and more')", "'a long text of several words about ' || event_type || ' and more'"),
    "few": ("concat('some ', event_type)", "'some ' || event_type"),
    "word": ("concat('k=', event_type)", "'k=' || event_type"),
    "none": ("if(event_id < 0, 'x', '')", "if(event_id < 0, 'x', '')"),
}


def _shape_sql() -> str:
    union = " UNION ALL ".join(f"SELECT event_id AS pos, '{n}' AS field, {sql} AS sval FROM events" for n, (_, sql) in _SHAPED.items())
    tests = " ".join(f"WHEN bool_and(regexp_matches(s, '{p}')) THEN '{n}'" for n, p in S.SHAPES)
    return f"""WITH c AS ({union}), v AS (SELECT field, trim(sval) AS s FROM c WHERE sval <> '' QUALIFY row_number() OVER (PARTITION BY field ORDER BY pos) <= 500),
k AS (SELECT field, CASE {tests} WHEN bool_and(NOT contains(s, ' ')) THEN 'token' WHEN bool_and(upper(s) = s AND lower(s) <> s) THEN 'code' WHEN avg(length(s)) > 40 THEN 'free-text' ELSE 'token' END AS shape FROM v GROUP BY field)
SELECT f.field, coalesce(shape, 'empty') AS shape FROM (SELECT DISTINCT field FROM c) f LEFT JOIN k ON k.field = f.field"""


@query(_shape_sql())
def value_shape_kinds(spark, sf_dir):
    """a field of every shape"""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), *[F.expr(x).alias(n) for n, (x, _) in _SHAPED.items()])
    return profile.value_shapes(cells(e, "pos", list(_SHAPED)))


@query("""WITH t AS (SELECT event_id, date_trunc('second', ts) AS s FROM events)
SELECT event_id, epoch_us(s) AS slash, epoch_us(date_trunc('minute', s)) AS minutes, epoch_us(s) AS dash, epoch_us(s) AS dots, epoch_us(s) AS plain_common, epoch_us(s) AS year_last, epoch_us(date_trunc('hour', s)) AS hours, epoch_us(s) AS basic, epoch_us(s) - 3600000000 AS east, epoch_us(date_trunc('day', s)) AS week, epoch_us(s) AS any_sign FROM t""")
def clock_forms(spark, sf_dir):
    """F4 to F7: forms that the other query has not"""
    e = table(spark, sf_dir, "events").withColumn("s", F.date_trunc("second", "ts"))
    f = lambda form: F.date_format("s", form)
    monday = F.date_add(F.to_date("s"), 3 - F.weekday("s"))  # the week's Thursday tells its year
    week = F.concat(F.year(monday), F.lit("-W"), F.lpad(F.weekofyear("s").cast("string"), 2, "0"), F.lit("-"), F.weekday("s") + 1)
    return e.select(
        "event_id",
        S.dmy_micros(f("d/M/yyyy H:m:s")).alias("slash"),
        S.dmy_micros(f("d/M/yyyy H:m")).alias("minutes"),
        S.dmy_micros(f("dd-MM-yyyy HH:mm:ss")).alias("dash"),
        S.dmy_micros(f("d.M.yyyy HH:mm:ss")).alias("dots"),
        S.common_micros(f("dd/MMM/yyyy HH:mm:ss")).alias("plain_common"),
        S.common_micros(f("MMM d HH:mm:ss yyyy")).alias("year_last"),
        S.iso_micros(f("yyyy-MM-dd'T'HH")).alias("hours"),
        S.iso_micros(f("yyyyMMdd'T'HHmmss")).alias("basic"),
        S.iso_micros(F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit("+01"))).alias("east"),
        S.iso_micros(week).alias("week"),
        S.iso_micros(F.concat(f("yyyy-MM-dd"), F.lit("_"), f("HH:mm:ss,000"))).alias("any_sign"),
    )


_MASKED_SQL = "CASE event_id % 3 WHEN 0 THEN 'u' || user_id WHEN 1 THEN '<USER>' END"


@query(f"""SELECT event_id, CASE WHEN v IS NULL THEN 'absent' WHEN regexp_matches(v, '{_PLACEHOLDER_SQL}') THEN 'redacted' ELSE 'exact' END AS user_state, if(regexp_matches(v, '{_PLACEHOLDER_SQL}'), v, NULL) AS user_placeholder,
if(event_id % 5 = 0, 'empty', 'exact') AS note_state, CASE WHEN v IS NULL THEN 'None' WHEN regexp_matches(v, '{_PLACEHOLDER_SQL}') THEN '(redacted)' ELSE v END || ':' || event_type AS canonical_name, if(event_id % 4 = 0, 'resolved', 'unresolved') AS clock, len(list_filter([event_id % 3 = 1], lambda x: x)) AS hidden
FROM (SELECT *, {_MASKED_SQL} AS v FROM events)""")
def project_states(spark, sf_dir):
    """F16, F17: fields that are absent, empty, redacted and exact; times that are there and not"""
    e = table(spark, sf_dir, "events")
    who = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), "user_id")).when(F.col("event_id") % 3 == 1, "<USER>")
    note = F.when(F.col("event_id") % 5 == 0, "").otherwise("said")
    when = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    r = e.select("event_id", who.alias("who"), "event_type", note.alias("note"), when.alias("at"))
    schema = {"identity_key": ["who", "event_type"], "time_field": "at", "record_layers": {"envelope": [{"path": "who", "role": "identity"}, {"path": "event_type", "role": "identity"}], "payload": [{"path": "note", "role": "content"}]}, "classes": []}
    x = project.project(schema, r, "event_id")
    state = lambda i: F.get("fields", F.lit(i))["state"]
    hidden = F.size(F.filter("notes", lambda n: n == "identity has a redacted component")).cast("long")
    return x.select(F.col("index").alias("event_id"), state(0)["state"].alias("user_state"), state(0)["placeholder"].alias("user_placeholder"), state(2)["state"].alias("note_state"), "identity.canonical_name", F.when(F.col("wall.precision") == "exact", "resolved").otherwise(F.col("wall.precision")).alias("clock"), hidden.alias("hidden"))


_HIDDEN = "CASE WHEN event_id % 3 < 2 THEN '<HOST>' ELSE 'h' || event_id END"


@query(f"""WITH r AS (SELECT 'host' AS candidate, {_HIDDEN} AS key FROM events UNION ALL SELECT 'part', CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' ELSE 'p' || event_id % 40 END FROM events),
g AS (SELECT candidate, key, count(*) AS n FROM r WHERE key IS NOT NULL AND key NOT IN ('', 'None') GROUP BY ALL)
SELECT candidate, count(*) AS groups, count(*) FILTER (n = 1) AS singletons, round(sum(n) FILTER (regexp_matches(key, '{_PLACEHOLDER_SQL}')) / sum(n), 6) AS masked, if(candidate = 'host', 'noise', if(sum(n) / count(*) >= 50, 'bucket', 'entity')) AS verdict FROM g GROUP BY candidate""")
def identity_masked(spark, sf_dir):
    """A12, PF2, rule 2: masked keys identify nothing; null, empty and None are no keys"""
    e = table(spark, sf_dir, "events")
    host = F.when(F.col("event_id") % 3 < 2, "<HOST>").otherwise(F.concat(F.lit("h"), "event_id"))
    part = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, "None").when(F.col("event_id") % 4 == 3, F.concat(F.lit("p"), F.col("event_id") % 40))
    m = identity.measure(e.select(host.alias("host"), part.alias("part")), _singles(["host", "part"]))
    return m.select("candidate", "groups", "singletons", F.round(F.nullif("placeholder_rate", F.lit(0.0)), 6).alias("masked"), "verdict")


_POOL_KEYS = ["event_id", "user_id", "event_type", "props", "hour", "value"]


@query(f"""WITH i AS ({_identity_sql("events", {k: f"CAST({k} AS VARCHAR)" for k in _POOL_KEYS if k != "hour"} | {"hour": "strftime(ts, '%Y-%m-%d %H')"}, "ts")}),
p AS (SELECT candidate FROM i WHERE verdict IN ('session', 'entity', 'bucket') ORDER BY groups DESC, candidate LIMIT 8)
SELECT a.candidate AS one, b.candidate AS other FROM p a JOIN p b ON a.candidate < b.candidate""")
def identity_pool(spark, sf_dir):
    """J4, PF6, T3: the pairs that single fields' verdicts lead to"""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    singles = [r.asDict() for r in identity.measure(e, _singles(_POOL_KEYS), F.unix_micros("ts")).collect()]
    return spark.createDataFrame(identity.pair_candidates(singles, e.count()), "one string, other string")


def _json_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines of events: with keys that few have, nulls, blanks, records over two lines and lines that are no records."""
    e = table(spark, sf_dir, "events").withColumn("i", F.col("event_id"))
    rare = F.when(F.col("i") % 10 == 0, F.col("user_id"))
    body = F.struct(F.col("i").alias("id"), F.col("event_type").alias("type"), F.col("value").alias("amount"), rare.alias("few"), (F.col("i") % 2 == 0).alias("even"), F.when(F.col("i") % 4 == 0, " ").otherwise("x").alias("blank"), F.struct(F.lit(1).alias("a")).alias("deep"))
    text = F.regexp_replace(F.to_json(body), r"\}$", ',"gone":null}')
    text = F.when(F.col("i") % 7 == 0, F.regexp_replace(text, '^\\{"id"', '{\n "id"')).otherwise(text)
    text = F.when(F.col("i") % 11 == 0, F.concat(F.lit("stray\n"), text)).otherwise(text)
    text = F.when(F.col("i") % 13 == 0, F.concat(text, F.lit("\n\t \n{bad}\n[1, 2]"))).otherwise(text)
    where = folder(spark, "lines.jsonl")
    e.select(text.alias("value")).write.text(where)
    return where


@query("""WITH e AS (SELECT event_id AS i, * FROM events), c(field, kind, present, non_null) AS (
SELECT 'id', 'int', count(*), count(*) FROM e UNION ALL SELECT 'type', 'str', count(event_type), count(event_type) FROM e UNION ALL SELECT 'amount', 'float', count(value), count(value) FROM e
UNION ALL SELECT 'few', 'int', count(*) FILTER (i % 10 = 0), count(*) FILTER (i % 10 = 0) FROM e UNION ALL SELECT 'even', 'bool', count(*), count(*) FROM e
UNION ALL SELECT 'blank', if(count(*) FILTER (i % 4 = 0) > count(*) FILTER (i % 4 <> 0), 'empty-string', 'str'), count(*), count(*) FROM e UNION ALL SELECT 'deep', 'structured', count(*), count(*) FROM e UNION ALL SELECT 'gone', 'always-null', count(*), 0 FROM e)
SELECT *, round(non_null / present, 6) AS fill_rate FROM c WHERE present > 0""")
def jsonl_profile(spark, sf_dir):
    """SRC6, A1 to A3, F1: kinds, presence and fill of the keys of JSON records"""
    c = cells(readers.read_jsonl(spark, _json_lines(spark, sf_dir)), "pos")
    p = profile.profile_fields(c).join(profile.dominant_kinds(c), "field")
    return p.select("field", "kind", "present", "non_null", *r6("fill_rate"))


@query("""SELECT count(*) AS records, count(*) FILTER (event_id % 7 = 0) AS joined, count(*) FILTER (event_id % 11 = 0) + 2 * count(*) FILTER (event_id % 13 = 0) AS skipped, least(count(*), 100) AS first, count(*) > 100 AS cut FROM events""")
def jsonl_disclosure(spark, sf_dir):
    """SRC6, T7, SNK1: records, joined and skipped lines; a limit keeps the first records and says that there are more"""
    where = _json_lines(spark, sf_dir)
    sub, d, _ = readers.read(spark, where, None, Substrate("jsonl", where))
    _, top, cut = readers.read(spark, where, 100, Substrate("jsonl", where))
    return spark.createDataFrame([(d.count(), sub.joined, sub.skipped, top.filter("pos < 100").count(), cut)], "records long, joined long, skipped long, first long, cut boolean")


@query("""SELECT c_custkey::VARCHAR AS c_custkey, if(c_custkey % 5 = 0, c_name || chr(10) || '"' || c_custkey || '", x', c_name) AS c_name, if(c_custkey % 3 = 0, '', c_mktsegment) AS c_mktsegment FROM customer""")
def delimited_cells(spark, sf_dir):
    """SRC8: delimited records with quoted line breaks, quotes and separators, and empty cells"""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat("c_name", F.lit('\n"'), key, F.lit('", x'))).otherwise(F.col("c_name"))
    where = folder(spark, "customer.csv")
    c.select(key, name.alias("c_name"), F.when(key % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")).write.option("escape", '"').option("emptyValue", "").csv(where, header=True)
    return readers.read_delimited(spark, where, ",").drop("pos")


@query("""WITH d AS (SELECT n_name FROM nation) SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey::VARCHAR AS n_nationkey, n_name, if(n_regionkey = 0, NULL, n_regionkey::VARCHAR) AS n_regionkey, if(n_regionkey = 0, 'absent', 'int') AS region_kind FROM nation""")
def json_document(spark, sf_dir):
    """SRC7: an object with a list under rows; a document is one value, so this one is of a small table"""
    n = table(spark, sf_dir, "nation")
    row = F.struct("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(0)).alias("n_regionkey"))
    where = folder(spark, "nation.json")
    doc = F.to_json(F.struct(F.lit(25).alias("of"), F.array_sort(F.collect_list(row)).alias("rows")))
    n.agg(doc.alias("value")).coalesce(1).write.text(where)
    d = readers.read_json(spark, where)
    return d.select("pos", "n_nationkey", "n_name", "n_regionkey", F.coalesce(F.col(f"`{readers.TYPES}`")["n_regionkey"], F.lit("absent")).alias("region_kind"))


@query("""WITH e AS (SELECT event_id, ts + to_days(CAST(user_id % 366 AS INTEGER)) AS t FROM events), s AS (SELECT event_id, unnest([2023, 2024, 2025]) AS y, t FROM e),
c AS (SELECT event_id, try_strptime(y || strftime(t, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS t FROM s), g AS (SELECT *, abs(epoch_us(t) - epoch_us(TIMESTAMP '2024-02-01 00:00:00')) AS gap FROM c WHERE t IS NOT NULL),
o AS (SELECT *, lead(gap) OVER w AS following, row_number() OVER w AS at_ FROM g WINDOW w AS (PARTITION BY event_id ORDER BY gap, t)), y AS (SELECT * FROM o WHERE at_ = 1),
f AS (SELECT count(*) AS records, count(*) FILTER (event_id % 6 = 0) AS joined, 2024 AS year, 'rotation-suffix' AS year_source, count(*) FILTER (year(t) <> 2024) AS wrapped, count(*) FILTER (gap > 0 AND following < 1.5 * gap) AS ambiguous FROM y)
SELECT strftime(t, '%Y-%m-%dT%H') AS hour, count(*) AS n, f.* FROM y CROSS JOIN f GROUP BY ALL""")
def syslog_file(spark, sf_dir):
    """SRC12, SRC14 to SRC16: a rotated file of records and continuation lines, and what its reader discloses"""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts") + F.make_dt_interval((F.col("user_id") % 366).cast("int")))
    line = F.concat(F.date_format("t", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("t").cast("string"), 2, " "), F.lit(" "), F.date_format("t", "HH:mm:ss"), F.lit(" mx1 app["), F.col("user_id"), F.lit("]: said"))
    line = F.when(F.col("event_id") % 6 == 0, F.concat(line, F.lit("\n\t \n\tat line 1"))).otherwise(line)
    where = folder(spark, "maillog-20240201")
    e.select(line.alias("value")).write.text(where)
    sub = Substrate("syslog", where, dialect="bsd")
    d = readers.read_syslog(spark, where, "bsd", sub)
    facts = {"records": sub.read, "joined": sub.joined} | {k: sub.syslog[n] for k, n in (("year", "year"), ("year_source", "year_source"), ("wrapped", "year_wrapped_records"), ("ambiguous", "year_ambiguous_records"))}
    return d.groupBy(F.substring("stamp", 1, 13).alias("hour")).agg(F.count("*").alias("n")).select("hour", "n", *[F.lit(v).alias(k) for k, v in facts.items()])
