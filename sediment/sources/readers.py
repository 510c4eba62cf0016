"""Readers: a file of any detected format as records with an order column `pos`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.scalars import blank
from .detect import HEAD, Substrate, detect
from .jsonrecords import TYPES, Assembler, document, tag, text
from .syslog import SHOWN_UNMATCHED, join_continuations, matches, parse_bsd, parse_rfc5424, reference_year

WRAPPERS = ("records", "rows", "data", "items", "logs")
_RAW = "record: raw"


def numbered(df: DataFrame) -> DataFrame:
    """df, of a file scan and filters on it, with `pos`, dense in order of file, split and row.

    Counts per partition meet on the driver (one number each); no row moves.
    """
    d = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__block", F.col("_metadata.file_block_start")).withColumn("__row", F.monotonically_increasing_id())
    d = d.withColumn("__part", F.spark_partition_id())
    runs = d.groupBy("__file", "__block", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("n"))
    w = Window.orderBy("__file", "__block", "__first").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    out = d.join(F.broadcast(runs), ["__file", "__block", "__part"]).withColumn("pos", F.col("__before") + F.col("__row") - F.col("__first"))
    return out.drop("__block", "__part", "__row", "__first", "__before").withColumnRenamed("__file", "file")


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, of a text file; bytes that aren't UTF-8 are replaced."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("line"), "_metadata")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """lines(file, pos, line) of a text file, those of white space left out."""
    return numbered(_text_lines(spark, path).filter(~blank(F.col("line")))).select("file", "pos", "line")


def _file(spark: SparkSession, path: str, folder_too: bool = False):
    """(file system, path, status) of one file in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"no such log file: {path}")
    status = fs.getFileStatus(p)
    if status.isDirectory() and not folder_too:
        raise IsADirectoryError(f"{path} is a directory; point at a file")
    return fs, p, status


def head_of(spark: SparkSession, path: str) -> tuple[bytes, bool]:
    """The first 64 KiB of a file in any store, and whether that is all; nothing else is read."""
    fs, p, status = _file(spark, path)
    stream = fs.open(p)
    try:
        n = min(HEAD, status.getLen())
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n) if n else b""
    finally:
        stream.close()
    return bytes(data), status.getLen() <= HEAD


def _blocks(batches):
    """(file, start of the split, lines) for each split of a partition, in order; lines is an iterator."""
    import itertools

    def rows():
        for b in batches:
            yield from zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("line").to_pylist())

    for (file, block), part in itertools.groupby(rows(), key=lambda r: r[:2]):
        yield file, block, (r[2] for r in part)


def _survey(carried: dict):
    """A row for each split: records, lines joined and skipped, keys, and the lines that it leaves open."""

    def survey(batches):
        import pyarrow as pa

        for file, block, lines in _blocks(batches):
            a, n, keys = Assembler(carried.get((file, block), [])), 0, set()
            for line in lines:
                record = a.feed(line)
                if record is not None:
                    n += 1
                    keys.update(record)
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "n": n, "joined": a.joined, "skipped": a.skipped, "keys": sorted(map(text, keys)), "open": a.held}], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("joined", pa.int64()), ("skipped", pa.int64()), ("keys", pa.list_(pa.string())), ("open", pa.list_(pa.string()))]))

    return survey


def _names(keys) -> dict[str, str]:
    """A column for each key; Spark doesn't tell names apart by case, so such keys get a number."""
    out, taken = {}, {"pos", TYPES}
    for k in sorted(keys):
        name, n = k, 2
        while name.lower() in taken:
            name, n = f"{k} ({n})", n + 1
        taken.add(name.lower())
        out[k] = name
    return out


def _schema(names: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField("pos", T.LongType()), *(T.StructField(n, T.StringType()) for n in names.values()), T.StructField(TYPES, T.MapType(T.StringType(), T.StringType()))])


def _batches(records, names: dict[str, str], most: int = 2000):
    """Arrow batches of (pos, record) pairs: a column of texts for each key, and the map of tags."""
    import itertools

    import pyarrow as pa

    records = iter(records)
    while held := list(itertools.islice(records, most)):
        rows = [{text(k): v for k, v in r.items()} for _, r in held]
        cols = [pa.array([p for p, _ in held], pa.int64()), *(pa.array([text(r.get(k)) for r in rows], pa.string()) for k in names)]
        cols.append(pa.array([[(names[k], tag(v)) for k, v in r.items()] for r in rows], pa.map_(pa.string(), pa.string())))
        yield pa.RecordBatch.from_arrays(cols, names=["pos", *names.values(), TYPES])


def read_jsonl(spark: SparkSession, path: str, sub: Substrate | None = None) -> DataFrame:
    """Records of JSON Lines, each on one line or on several: a column of text for each key, and TYPES.

    Every split is read by itself, from the lines that the one before leaves
    open: a first pass counts records and finds these lines, and repeats splits
    that begin inside a record, few lines at most; the second gives the records.
    The driver holds a row a split. Joined and skipped lines are counted in sub.
    """
    lines = _text_lines(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "line")
    kinds = "file string, block long, n long, joined long, skipped long, keys array<string>, open array<string>"
    carried: dict = {}
    found = {(r.file, r.block): r for r in lines.mapInArrow(_survey(carried), kinds).collect()}
    while True:
        order = sorted(found)
        late = {b: list(found[a].open) for a, b in zip(order, order[1:]) if a[0] == b[0] and list(found[a].open) != carried.get(b, [])}
        if not late:
            break
        carried |= late
        again = spark.createDataFrame([(*k,) for k in late], "file string, block long")
        part = lines.join(F.broadcast(again), ["file", "block"], "left_semi").select("file", "block", "line")
        got = {(r.file, r.block): r for r in part.mapInArrow(_survey(dict(carried)), kinds).collect()}
        found |= got
    names = _names({k for r in found.values() for k in r["keys"]})
    start, n = {}, 0
    for k in sorted(found):
        start[k], n = n, n + found[k].n
    if sub is not None:
        last = {k[0]: k for k in sorted(found)}
        sub.read, sub.joined = n, sum(r.joined for r in found.values())
        sub.skipped = sum(r.skipped for r in found.values()) + sum(len(found[k].open) for k in last.values())
    schema = _schema(names)

    def give(batches):
        for file, block, part in _blocks(batches):
            a, pos = Assembler(carried.get((file, block), [])), start.get((file, block), 0)

            def records(pos=pos, a=a, part=part):
                for line in part:
                    record = a.feed(line)
                    if record is not None:
                        yield pos, record
                        pos += 1

            yield from _batches(records(), names)

    return lines.mapInArrow(give, schema)


def read_json(spark: SparkSession, path: str, sub: Substrate | None = None) -> DataFrame:
    """Records of a JSON document: an array, or an object with a list under records, rows, data, items or logs.

    A document is parsed whole, in one task; beyond 2 GB it should be JSON Lines.
    """
    docs = spark.read.text(path, wholetext=True).select(F.make_valid_utf8("value").alias("text"))

    def keys(batches):
        import pyarrow as pa

        for b in batches:
            for raw in b.column("text").to_pylist():
                rows = document(raw, WRAPPERS)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64()), "keys": pa.array([sorted({text(k) for r in rows for k in r})], pa.list_(pa.string()))})

    found = docs.mapInArrow(keys, "n long, keys array<string>").collect()
    names = _names({k for r in found for k in r["keys"]})
    if sub is not None:
        sub.read = sum(r.n for r in found)

    def give(batches):
        for b in batches:
            for raw in b.column("text").to_pylist():
                yield from _batches(enumerate(document(raw, WRAPPERS)), names)

    return docs.mapInArrow(give, _schema(names))


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Records of a delimited file with a header; all values text, surplus cells dropped, missing ones null, empty ones empty.

    Only a file with line breaks inside quotes is read in one task.
    """
    marks = F.length("value") - F.length(F.replace("value", F.lit('"')))
    broken = bool(spark.read.text(path).filter(marks % 2 == 1).limit(1).count())
    form = {"header": True, "sep": sep, "multiLine": broken, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    names = spark.read.options(**form).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, _RAW)])
    d = numbered(spark.read.options(**form, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, columnPruning=False).csv(path, schema=schema).select("*", "_metadata"))
    # Spark gives null for an empty cell as for a missing one; only rows of another length are kept raw
    raw = F.col(f"`{_RAW}`")
    cells = F.size(F.split(F.regexp_replace(raw, '"(?:[^"]|"")*"', "q"), "\\Q" + sep + "\\E", -1))
    here = lambda i: raw.isNull() | (F.lit(i) < cells)
    return d.select("pos", *[F.when(here(i), F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip()) for i, c in enumerate(names)])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, path).select("pos", F.col("line").alias("message"))


def read_syslog(spark: SparkSession, path: str, dialect: str, sub: Substrate | None = None) -> DataFrame:
    """Syslog records with continuation lines joined; stamps get the nearest year to the file's own date.

    What was assumed and what was left out is counted in sub.
    """
    lines = lines_of(spark, path)
    modified = dt.datetime.fromtimestamp(_file(spark, path, True)[2].getModificationTime() / 1000, dt.timezone.utc).replace(tzinfo=None)
    ref, source = reference_year(path.rstrip("/").rpartition("/")[2], modified)
    reference = F.lit(ref).cast("timestamp_ntz").cast("timestamp") if ref else F.lit(None).cast("timestamp")

    def parse(c: Column) -> Column:
        return parse_bsd(c, reference) if dialect == "bsd" else parse_rfc5424(c)

    records, unmatched = join_continuations(lines, matches(F.col("line"), dialect))
    first = F.substring_index("line", "\n", 1)
    rest = F.substring("line", F.length(first) + 1, F.length("line"))
    p = records.select(F.col("ordinal").alias("pos"), parse(first).alias("p"), rest.alias("rest"), "joined")
    if sub is not None:
        a = p.agg(F.count("*").alias("n"), F.coalesce(F.sum("joined"), F.lit(0)).alias("joined"), F.count_if("p.wrapped").alias("wrapped"), F.count_if("p.ambiguous").alias("ambiguous")).first()
        sub.read, sub.joined, sub.skipped = a.n, a.joined, unmatched.count()
        shown = [r.line[:160] for r in unmatched.orderBy("file", "pos").limit(SHOWN_UNMATCHED).collect()] if sub.skipped else []
        bsd = dialect == "bsd"
        sub.syslog = {"dialect": dialect, "year": ref.year if bsd and ref else None, "year_source": source if bsd else "in the file", "year_assumed": bsd, "year_wrapped_records": a.wrapped, "year_ambiguous_records": a.ambiguous, "undated_records": a.n if bsd and not ref else 0, "unmatched_lines": sub.skipped, "joined_continuation_lines": a.joined, "unmatched_samples": shown}
    return p.select("pos", "p.stamp", "p.host", "p.ident", "p.pid", F.concat("p.message", "rest").alias("message"))


def read(spark: SparkSession, path: str, limit: int | None = None, sub: Substrate | None = None) -> tuple[Substrate, DataFrame, bool]:
    """(format, records with pos, hit_limit) of a file; limit keeps the first records and says whether there are more.

    Records are numbered without gaps, so the limit is a filter on pos.
    """
    sub = sub or detect(path, *head_of(spark, path))
    if sub.kind == "jsonl":
        d = read_jsonl(spark, path, sub)
    elif sub.kind == "json":
        d = read_json(spark, path, sub)
    elif sub.kind == "delimited":
        d = read_delimited(spark, path, sub.delimiter)
    elif sub.kind == "syslog":
        d = read_syslog(spark, path, sub.dialect, sub)
    else:
        d = read_text(spark, path)
    if limit is None:
        return sub, d, False
    more = sub.read > limit if sub.read else not d.filter(F.col("pos") >= limit).isEmpty()
    if more:
        sub.read = limit
    return sub, d.filter(F.col("pos") < limit), more
