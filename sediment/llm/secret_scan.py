"""Secret scans over an incremental ledger of blobs, in DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its content. The
ledger holds which (blob, rule, version of the rule) has been scanned and what
was found. A scan takes the blobs of the given versions, drops pairs that the
ledger has, evaluates the remaining rules once on each distinct blob, extends
the ledger, and joins findings back to all paths.

Contents are scanned where they lie. What most blobs need (all rules in a first
scan, only new rules or nothing later) is the rule; blobs that need something
else, and copies, are exceptions that contents are joined with. Exceptions are
broadcast if they are few, else the join deals contents by blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ._scratch import Scratch, exists

#: Most exceptions that are broadcast; one has about 150 bytes.
FEW = 50_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: every leftmost match of pattern whose group `of` has `least` characters or more."""

    kind: str
    pattern: str
    of: int = 0
    least: int = 1
    version: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run is matched whole and kept if long enough; asking for the length at once finds the same runs
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats that vendors publish.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    # Header, body and end; without an end, the lines of the body that follow
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\x20\x09-\x0D-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=]{16,})*)", version=2),
)
LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,end:int>>"


_BLOCK = 128


def _once(value: Column, f) -> Column:
    """f(value), with value computed once a row however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _before(lens: Column, f) -> Column:
    """f(g), with g(i) the sum of the first i values of an array.

    From sums of blocks and the rest of one block, so a place costs a block's
    size at most, whatever the array's.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / _BLOCK).cast("int")), lambda b: _total(F.slice(lens, b * _BLOCK + 1, _BLOCK)))

    def upto(sums: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(sums)), lambda b: _total(F.slice(sums, 1, b)))

    def place(sums: Column):
        def at(i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            return F.get(sums, b) + _total(F.slice(lens, b * _BLOCK + 1, i - b * _BLOCK))

        return at

    return _once(blocks, lambda x: _once(upto(x), lambda y: f(place(y))))


def _found(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points, from the lengths of matches and of the gaps between them."""
    p = F.lit(rule.pattern)
    sizes = lambda x: F.transform(x, lambda m: F.length(m))

    def spans(lens: Column) -> Column:
        own = lens if rule.of == 0 else sizes(F.regexp_extract_all(text, p, F.lit(rule.of)))
        parts = F.struct(sizes(F.split(text, rule.pattern, -1)).alias("gaps"), own.alias("own"))

        def of(x: Column) -> Column:
            steps = F.zip_with(x["gaps"], lens, lambda g, n: g + F.coalesce(n, F.lit(0)))

            def placed(before) -> Column:
                def one(n: Column, i: Column) -> Column:
                    start = before(i) + F.get(x["gaps"], i)
                    return F.struct(start.alias("start"), (start + n).alias("end"), F.get(x["own"], i).alias("n"))

                return F.transform(F.filter(F.transform(lens, one), lambda y: y["n"] >= rule.least), lambda y: F.struct(y["start"], y["end"]))

            return _once(steps, lambda s: _before(s, placed))

        return F.when(F.size(lens) > 0, _once(parts, of)).otherwise(F.array().cast(_SPANS))

    return _once(sizes(F.regexp_extract_all(text, p, F.lit(0))), spans)


def _key(c: str) -> Column:
    """Null paths are one path."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def scan(versions: DataFrame, tmp: Scratch, ledger: DataFrame | None = None, rules=BASE + MORE) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of versions(path, content).

    findings: path, blob and spans(kind, start, end) of each version, in order
    of start, then of rules. New ledger rows: blob, rule, version, spans of the
    pairs that ledger (same columns) has not. Null content counts as empty, a
    null path is a path like others. A blob is scanned at one of its paths; a
    repeated version, the same path with the same content, is returned as often
    as it occurs. Empty tables give no rows. Contents are scanned whole, in time
    that grows with their length.
    """
    spark = versions.sparkSession
    v = versions.select("path", F.coalesce("content", F.lit("")).alias("content"))
    blob = F.unhex(F.sha2("content", 256))
    named = tmp.save(v.select("path", blob.alias("blob")), "named")
    names = [(r.kind, r.version) for r in rules]
    marks = {(k, n): f"{k}@{n}" for k, n in names}
    wanted = F.array(*[F.lit(m) for m in marks.values()])
    state = named.groupBy("blob").agg(F.min(_key("path")).alias("holder"), (F.count("*") > 1).alias("copies"))
    if ledger is None:
        known, state = None, state.withColumn("todo", wanted)
    else:
        now = spark.createDataFrame(names, "rule string, version int")
        known = ledger.join(F.broadcast(now), ["rule", "version"], "left_semi").select("blob", "rule", "version", "spans")
        done = known.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
        state = state.join(done, "blob", "left").withColumn("todo", F.filter(wanted, lambda m: ~F.array_contains(F.coalesce("done", F.array().cast("array<string>")), m))).drop("done")
    state = tmp.save(state, "state")
    # one row for each set of rules that some blob needs
    usual = state.groupBy("todo").count().orderBy(F.desc("count"), "todo").first()
    usual = list(usual.todo) if usual else []
    usual_todo = F.array(*[F.lit(m) for m in usual]).cast("array<string>")
    other = state.filter((F.col("todo") != usual_todo) | (F.col("copies") & (F.size("todo") > 0))).select(F.col("blob").alias("of"), "holder", F.col("todo").alias("own"))
    if other.limit(FEW + 1).count() <= FEW:
        other = F.broadcast(other)
    texts = v.withColumn("blob", blob).join(other, F.col("blob") == F.col("of"), "left")
    need = F.when(F.col("of").isNull(), usual_todo).when(F.col("holder") == _key("path"), F.col("own")).otherwise(F.array().cast("array<string>"))
    texts = texts.select("blob", "content", need.alias("todo")).filter(F.size("todo") > 0)
    per = F.array(*[F.when(F.array_contains("todo", marks[r.kind, r.version]), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _found(F.col("content"), r).alias("spans"))) for r in rules])
    new = texts.select("blob", F.explode(F.filter(per, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")
    new = tmp.save(new, "new")
    known = new if known is None else new.unionByName(known)
    place = F.array_position(F.array(*[F.lit(k) for k, _ in names]), F.col("rule"))
    hits = known.filter(F.size("spans") > 0).select("blob", place.alias("place"), "rule", F.explode("spans").alias("s"))
    hits = hits.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), "place", F.col("s.end").alias("end"), F.col("rule").alias("kind")))).alias("found"))
    hits = hits.select("blob", F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return named.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans")), new


def scan_into(versions: DataFrame, tmp: Scratch, uri: str, rules=BASE + MORE) -> tuple[DataFrame, DataFrame]:
    """scan() through the ledger at uri, a Parquet table in a store that all executors share, which it extends.

    Without a table at uri the ledger is empty. Two scans must not extend one
    ledger at the same time; a pair that it holds twice counts once.
    """
    spark = versions.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(uri) if exists(spark, uri) else None
    findings, new = scan(versions, tmp, ledger, rules)
    new.write.mode("append").parquet(uri)
    return findings, new


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each run of overlapping spans replaced by mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redact_documents(documents: DataFrame, tmp: Scratch, rules=BASE + MORE) -> DataFrame:
    """documents with secrets in text replaced, n_chars counted again; rows without secrets as they are.

    A text that no rule's pattern occurs in has no findings and is passed on
    where it lies; the others, a small part, are joined with findings by blob.
    Null and empty texts stay, as do repeated rows and rows without doc_id.
    Texts are read and rewritten whole. Columns are passed on whatever their
    names. An empty table gives no rows.
    """
    findings, _ = scan(documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), tmp, rules=rules)
    maybe = F.lit(False)
    for r in rules:
        maybe = maybe | F.coalesce(F.col("text").rlike(r.pattern), F.lit(False))
    # names that no table has: the documents may have columns called blob or spans
    hit = findings.filter(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias("secret: blob"), F.col("spans").alias("secret: spans"))
    d = documents.filter(maybe).withColumn("secret: of", F.unhex(F.sha2("text", 256))).join(hit, F.col("secret: of") == F.col("secret: blob"), "left")
    none = F.col("secret: spans").isNull()
    d = d.withColumn("secret: text", F.when(none, F.col("text")).otherwise(redact(F.col("text"), F.col("secret: spans"))))
    new = {"text": F.col("secret: text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(none, F.col("n_chars")).otherwise(F.length("secret: text").cast("long"))
    return documents.filter(~maybe).union(d.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns]))
