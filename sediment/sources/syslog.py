"""Syslog lines as records: parsing, nearest year, continuation lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import blank, once, trimmed
from .detect import BSD, RFC5424

# The months as syslog writes them.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MOST_CONTINUATIONS, AMBIGUOUS, SHOWN_UNMATCHED = 200, 1.5, 3
_CHUNK = 100_000  # lines that are numbered in one task


def nearest_year(mon: Column, day: Column, hms: Column, reference: Column) -> Column:
    """stamp, wrapped, ambiguous: the year next to the reference time that brings the stamp nearest to it.

    Impossible dates (Feb 29, unknown months) are no candidates; without any the
    stamp is null. Without a reference the year is 1970.
    """
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), mon), F.lit(0)).cast("int")
    ref = F.coalesce(reference, F.make_timestamp(F.lit(1970), F.lit(7), F.lit(2), F.lit(0), F.lit(0), F.lit(0)))
    part = lambda i: F.substring(hms, i, 2).cast("int")
    made = lambda y: F.try_make_timestamp(y, month, day.cast("int"), part(1), part(4), F.substring(hms, 7, 2).cast("decimal(8,6)"))
    years = F.when(reference.isNull(), F.array(F.lit(1970))).otherwise(F.array(F.year(ref) - 1, F.year(ref), F.year(ref) + 1))
    gap = lambda t: F.abs(F.unix_micros(t) - F.unix_micros(ref))
    dates = F.filter(F.transform(years, made), lambda t: t.isNotNull())
    found = F.array_sort(F.transform(dates, lambda t: F.struct(gap(t).alias("gap"), t.alias("t"))))
    return once(found, lambda x: _chosen(x, reference, ref))


def _chosen(found: Column, reference: Column, ref: Column) -> Column:
    best, next_ = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    close = F.coalesce((best["gap"] > 0) & (next_["gap"] < AMBIGUOUS * best["gap"]), F.lit(False)) & reference.isNotNull()
    return F.struct(F.date_format(best["t"], "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), (F.coalesce(F.year(best["t"]) != F.year(ref), F.lit(False)) & reference.isNotNull()).alias("wrapped"), close.alias("ambiguous"))


def parse_bsd(line: Column, reference: Column) -> Column:
    """stamp, host, ident, pid, message, wrapped, ambiguous of an RFC 3164 line, null for others."""

    def record(g: Column) -> Column:
        return once(nearest_year(g[0], g[1], g[2], reference), lambda y: F.struct(y["stamp"].alias("stamp"), g[3].alias("host"), g[4].alias("ident"), g[5].alias("pid"), g[6].alias("message"), y["wrapped"].alias("wrapped"), y["ambiguous"].alias("ambiguous")))

    return _groups(line, BSD, range(1, 8), record)


def parse_rfc5424(line: Column) -> Column:
    """stamp (as written), host, ident, pid, message of an RFC 5424 line, null for others."""
    return _groups(line, RFC5424, (3, 4, 5, 6, 9), lambda g: F.struct(g[0].alias("stamp"), g[1].alias("host"), g[2].alias("ident"), g[3].alias("pid"), g[4].alias("message"), F.lit(False).alias("wrapped"), F.lit(False).alias("ambiguous")))


def _groups(line: Column, pattern: str, numbers, f) -> Column:
    """f(array of the groups) of a line that matches, else null; each group is extracted once."""
    p = "(?d)" + pattern
    return once(line, lambda x: F.when(x.rlike(p), once(F.array(*[F.regexp_extract(x, p, i) for i in numbers]), f)))


def matches(line: Column, dialect: str) -> Column:
    """Whether a line begins a record."""
    return line.rlike("(?d)" + (BSD if dialect == "bsd" else RFC5424))


def join_continuations(lines: DataFrame, is_start: Column, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(records, unmatched) of lines(file, pos, line): lines that start nothing join the record before, up to 200 each.

    records(file, pos, ordinal, line, joined): pos is that of the first line,
    ordinal the record's number among all; unmatched(file, pos, line) are lines
    before the first record, and beyond the limit. Lines of white space are
    left out. A file is numbered in chunks of lines, each in a task of its own,
    from sums over the chunks before; a record's lines are at most 201.
    """
    x = lines.filter(~blank(F.col("line"))).select(file, "pos", "line", is_start.alias("start")).withColumn("chunk", F.floor(F.col("pos") / _CHUNK))
    w = Window.partitionBy(file, "chunk").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("n", F.row_number().over(w).cast("long"))
    x = x.withColumn("s", F.max(F.when(F.col("start"), F.col("n"))).over(upto)).withColumn("starts", F.sum(F.col("start").cast("long")).over(upto))
    c = x.groupBy(file, "chunk").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.max("starts").alias("starts"))
    before = Window.partitionBy(file).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    c = c.withColumn("carried", F.max(F.col("s") + F.col("base")).over(before)).withColumn("records", F.coalesce(F.sum("starts").over(before), F.lit(0)))
    x = x.join(c.select(file, "chunk", "base", "carried", "records"), [file, "chunk"])
    rec = F.coalesce(F.col("s") + F.col("base"), F.col("carried"))
    x = x.select(file, "pos", "line", rec.alias("rec"), (F.col("n") + F.col("base") - rec).alias("at"), (F.col("records") + F.col("starts") - 1).alias("ordinal"))
    bad = F.col("rec").isNull() | (F.col("at") > MOST_CONTINUATIONS)
    part = F.when(F.col("at") > 0, trimmed(F.col("line"))).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("t"))))
    out = x.filter(~bad).groupBy(file, "rec").agg(F.min("pos").alias("pos"), F.min("ordinal").alias("ordinal"), parts.alias("p"))
    out = out.select(file, "pos", "ordinal", F.array_join("p.t", "\n").alias("line"), (F.size("p") - 1).alias("joined"))
    return out, x.filter(bad).select(file, "pos", "line")


def reference_year(name: str, modified=None):
    """(reference date, where it is from): a rotation suffix -YYYYMMDD, else the file's time, else none."""
    import datetime as dt

    m = re.search(r"-(\d{4})(\d{2})(\d{2})$", re.sub(r"\.(gz|log|txt)$", "", name))
    if m:
        try:
            return dt.datetime(*map(int, m.groups())), "rotation-suffix"
        except ValueError:
            pass
    return (modified, "file-mtime") if modified else (None, "none")
