"""Scalar expressions over the text of a field; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What redaction leaves behind, and the patterns of value shapes.
PLACEHOLDER = r"<[A-Z][A-Z0-9_]{1,20}>|\[[A-Z]{3,12}\]|\*{3,}|x{3,}|REDACTED|MASKED|ANONYMISED|ANONYMIZED"
SHAPES = (
    ("integer", r"^[0-9]+$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("ipv4", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"),
    ("hex", r"^[0-9a-fA-F]{6,}$"),
    ("path", r"^(/|\./|\.\./|[A-Za-z]:\\)"),
)
# Seconds of epoch times lie in [1e8, 4e9]; the finer units in their bounds.
EPOCH_UNITS = ((1e8, 4e9, 1e6), (1e11, 4e12, 1e3), (1e14, 4e15, 1.0), (1e17, 4e18, 1e-3))
# Masks in their order, each replaced by a space. Here and in SHAPES digits are [0-9]: Python, Java
# and RE2, which all read these patterns, don't agree on the digits that \d stands for.
MASKS = (
    r"\[I:[^\]]*\](?::[0-9]+)?",
    r"\[([0-9]{1,3}\.){3}[0-9]{1,3}\](?::[0-9]+)?",
    r"\[(?:[A-Z]{3,12}|[0-9.]+)\]",
    r"\bQ:[0-9A-Za-z]+:",
    r"<[^<>\s]{1,40}>",
    r"\b[\w.+-]+@[\w.-]+\.\w+\b",
    r"\b([0-9]{1,3}\.){3}[0-9]{1,3}\b",
    r"\b[0-9a-fA-F]{8,}\b",
    r"\b[0-9]+(?:[.:,][0-9]+)*\b",
    r"\s+",
)
# Letters, digits and white space of any script, as a class holds them, and the edge of a word.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
# MASKS for text of any script.
ANY_MASKS = (
    r"\[I:[^\]]*\](?::\p{Nd}+)?",
    r"\[(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\](?::\p{Nd}+)?",
    r"\[(?:[A-Z]{3,12}|[\p{Nd}.]+)\]",
    rf"{_EDGE}Q:[0-9A-Za-z]+:",
    rf"<[^<>{_SPACE}]{{1,40}}>",
    rf"{_EDGE}[{_WORD}.+-]+@[{_WORD}.-]+\.[{_WORD}]+{_EDGE}",
    rf"{_EDGE}(\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}{_EDGE}",
    rf"{_EDGE}[0-9a-fA-F]{{8,}}{_EDGE}",
    rf"{_EDGE}\p{{Nd}}+(?:[.:,]\p{{Nd}}+)*{_EDGE}",
    rf"[{_SPACE}]+",
)
# Words that prose has and templates lack.
FUNCTION_WORDS = (
    "the a an and or but of in on at to for with by from is are was were be been it its this that these those as into about"
).split()
SHAPE_CHARS, SHAPE_WORDS = 120, 14
_BLANK = r"^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")


def blank(c: Column) -> Column:
    """Nothing but white space of any script."""
    return c.rlike(rf"^[{_SPACE}]*\z")


def once(value: Column, f) -> Column:
    """f(value), with value computed once a row however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def non_empty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def is_placeholder(c: Column) -> Column:
    return c.rlike(PLACEHOLDER)


def skeleton(c: Column) -> Column:
    """The literal wording of a line of any script, null where it is blank, too long, or prose."""
    s = trimmed(c)
    usable = (s != "") & (F.length(s) <= 4 * SHAPE_CHARS)
    out = s
    for m in ANY_MASKS:
        out = F.regexp_replace(out, m, " ")
    out = F.regexp_replace(F.regexp_replace(out, "[^A-Za-z0-9 ]+", " "), r"\s+", " ")
    out = F.trim(out)
    once = F.transform(F.array(out), lambda w: F.struct(w.alias("w"), F.split(w, " ").alias("t")))
    words = F.transform(once, lambda x: F.when((x["w"] != "") & (F.size(x["t"]) <= SHAPE_WORDS) & (F.size(F.filter(x["t"], lambda t: F.lower(t).isin(*FUNCTION_WORDS))) < 2), F.substring(x["w"], 1, SHAPE_CHARS)))
    return F.when(usable, F.element_at(words, 1))


def epoch_micros(c: Column) -> Column:
    """Microseconds of a number that lies in the bounds of an epoch unit, else null."""

    def scale(v: Column) -> Column:
        out = F.lit(None).cast("long")
        for lo, hi, unit in reversed(EPOCH_UNITS):
            out = F.when((F.abs(v) >= lo) & (F.abs(v) <= hi), F.round(v * unit).cast("long")).otherwise(out)
        return out

    return once(stripped(c).try_cast("double"), scale)


_DATE, _TIME, _ZONE = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?", r"(?:Z|[+-]\d{2}:?\d{2})?"
ISO = rf"^{_DATE}(?:[T ]{_TIME}{_ZONE})?$"
#: All other forms: basic dates, weeks, hours alone, basic times, offsets of hours, any one character between date and time.
_ANY_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}-\d|\d{4}W\d{3}"
_ANY_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
_ANY_ZONE = r"Z|[+-]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?|\d{2}(?:\d{2}(?:\.\d+)?)?)?"
ANY_ISO = rf"^(?:({_ANY_DATE})(?:[^\d]({_ANY_TIME})({_ANY_ZONE})?)?|(\d{{4}}-?W\d{{2}}))$"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _iso_date(s: Column) -> Column:
    """yyyy-MM-dd of a basic date or a day of a week, Monday where none is named; null for weeks that a year has not."""
    d = F.regexp_replace(s, "-", "")
    year, week, day = F.substring(d, 1, 4).cast("int"), F.substring(d, 6, 2).cast("int"), F.coalesce(F.nullif(F.substring(d, 8, 1), F.lit("")), F.lit("1")).cast("int")
    monday = F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))))
    of_week = F.date_add(monday, (week - 1) * 7 + day - 1)
    ok = week.between(1, 53) & day.between(1, 7) & (F.weekofyear(of_week) == week)
    of_week = F.when(ok, F.date_format(of_week, "yyyy-MM-dd"))
    return F.when(s.contains("W"), of_week).otherwise(F.regexp_replace(d, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def _iso_plain(s: Column) -> Column:
    """Any ISO form as yyyy-MM-dd HH:mm:ss.ffffff and offset."""
    part = lambda i: F.regexp_extract(s, ANY_ISO, i)
    time, zone = F.regexp_replace(part(2), ":", ""), F.regexp_replace(part(3), ":", "")
    clock = F.regexp_replace(F.rpad(F.regexp_replace(time, "[.,].*", ""), 6, "0"), r"^(\d{2})(\d{2})(\d{2})$", "$1:$2:$3")
    fraction = F.substring(F.regexp_extract(time, r"[.,](\d+)$", 1), 1, 6)
    offset = F.when(zone.isin("", "Z"), zone).otherwise(F.regexp_replace(F.rpad(F.substring(zone, 1, 5), 5, "0"), r"^(...)(..)$", "$1:$2"))
    return F.concat(_iso_date(F.concat(part(1), part(4))), F.lit(" "), clock, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), offset)


def iso_micros(c: Column) -> Column:
    """Microseconds of an ISO 8601 date or date and time, naive read as UTC, else null."""

    def full(s: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(s, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
        return F.when(s.rlike(ISO), plain).when(s.rlike(ANY_ISO), _iso_plain(s))

    return _micros(F.try_to_timestamp(once(stripped(c), full)))


def _first_form(s: Column, forms) -> Column:
    """Microseconds by the first of (pattern, format, text before the value) that matches; formats are tried on matches only."""

    def read(x: Column) -> Column:
        out = F.lit(None).cast("timestamp")
        for pattern, form, lead in reversed(forms):
            whole = F.concat(F.lit(lead), x) if lead else x
            out = F.when(x.rlike(pattern), F.try_to_timestamp(whole, F.lit(form))).otherwise(out)
        return out

    return _micros(once(s, read))


def dmy_micros(c: Column) -> Column:
    """Microseconds of day/month/year times with / - or . between, else null."""
    forms = (
        (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/yyyy H:m:s", ""),
        (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "d/M/yyyy H:m", ""),
        (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-M-yyyy H:m:s", ""),
        (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d.M.yyyy H:m:s", ""),
    )
    return _first_form(F.substring(stripped(c), 1, 19), forms)


def common_micros(c: Column) -> Column:
    """Microseconds of common-log and BSD times; without a year, 1900; else null."""
    forms = (
        (r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$", "d/MMM/yyyy:HH:mm:ss xx", ""),
        (r"^\d{1,2}/[A-Z][a-z]{2}/\d{4} \d{2}:\d{2}:\d{2}$", "d/MMM/yyyy HH:mm:ss", ""),
        (r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}$", "yyyy MMM d HH:mm:ss", "1900 "),
        (r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$", "MMM d HH:mm:ss yyyy", ""),
    )
    return _first_form(F.regexp_replace(stripped(c), r"\s+", " "), forms)


#: Strategies in the order they are tried; slash-date is the ISO parser by another name.
STRATEGIES = (("iso8601", iso_micros), ("epoch", epoch_micros), ("day-month-year", dmy_micros), ("apache-common", common_micros))


def clock_micros(c: Column) -> Column:
    """Microseconds by the first strategy that reads the value."""
    return once(c, lambda x: F.coalesce(*[f(x) for _, f in STRATEGIES]))


def message_ids(c: Column, pattern: str) -> Column:
    """Distinct matches of the one group of pattern, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)))


def field_state(c: Column) -> Column:
    """value, placeholder and state (absent, empty, redacted, exact) of a field."""
    masked = F.coalesce(is_placeholder(c), F.lit(False))
    state = F.when(c.isNull(), "absent").when(c == "", "empty").when(masked, "redacted").otherwise("exact")
    return F.struct(F.when(state == "exact", c).alias("value"), F.when(state == "redacted", c).alias("placeholder"), state.alias("state"))


def canonical_name(parts: list[Column]) -> Column:
    """Key parts joined by colons; a redacted part is hidden, a missing one is None."""
    return F.concat_ws(":", *[F.when(is_placeholder(p), "(redacted)").otherwise(F.coalesce(p, F.lit("None"))) for p in parts])
