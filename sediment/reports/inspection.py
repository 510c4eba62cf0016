"""The measurement report of one file, and what to ask its owner."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..operators.identity import VERDICTS, evidence
from ..operators.profile import content_rank, dominant_kinds, first_values
from ..operators.validate import Measurement
from ..sources.detect import Substrate
from ..sources.readers import read
from .rounding import rounded

LIMIT, EXAMPLES = 200_000, 3
MEANING = {
    "session": "a few events per key, close together in time",
    "entity": "events per key that stretch over time: a person or a host",
    "bucket": "very many events per key: a category, not a thing",
    "noise": "keys that hardly ever come back",
    "undetermined": "too little of the timeline was read to tell",
}


def inspect_path(spark: SparkSession, path: str, limit: int | None = LIMIT) -> dict:
    """The report of a file's first `limit` records; None reads all of them."""
    sub, records, cut = read(spark, path, limit)
    m = Measurement(records, hit_limit=cut, kept=limit is not None)
    try:
        return inspect(m, sub, limit)
    finally:
        m.close()


def inspect(m: Measurement, sub: Substrate, limit: int | None = LIMIT) -> dict:
    """Only small aggregates reach the driver: a row per field, candidate or top shape."""
    kinds = {r.field: r.kind for r in dominant_kinds(m.cells).collect()}
    some = first_values(m.cells, EXAMPLES).groupBy("field").agg(F.sort_array(F.collect_list(F.struct("pos", "sval"))).alias("v"))
    samples = {r.field: [x.sval for x in r.v] for r in some.collect()}
    fields = [m.profiles[n] | {"kind": kinds[n], "samples": samples.get(n, [])} for n in sorted(m.profiles)]
    content = [r.asDict() | m.profiles[r.field] for r in content_rank(m.cells).collect()]
    # Few values in all, not only among the first ones, make a field an enumeration
    content = sorted(content, key=lambda c: (c["distinct"] <= 16, -c["reuse"] * c["mean_words"], c["field"]))[:5]
    clock = m.clocks[0]["field"] if m.clocks else None
    text = content[0]["field"] if content else None
    keys = [r | {"evidence": evidence(r, m.hit_limit)} for r in m.identity(clock)]
    report = {
        "path": sub.path,
        "format": {k: v for k, v in vars(sub).items() if k != "path"},
        "scan": {"records": m.count, "limit": limit, "truncated": m.hit_limit, "available": sub.available},
        "coverage": {"is_prefix_of_timeline": m.hit_limit, "explanation": "a prefix of the timeline; Rescan without --limit" if m.hit_limit else "whole file", "verdicts": "indicative" if m.hit_limit else "final"},
        "fields": fields,
        "clocks": m.clocks[:5],
        "content": content,
        "identity": keys,
        "classes": _classes(m, text),
        "health": {"masked": [_pick(f, "field", "placeholder_rate") for f in fields if f["placeholder_rate"] > 0.01], "sparse": [_pick(f, "field", "fill_rate") for f in fields if f["fill_rate"] < 0.5]},
    }
    report = rounded(report)
    return report | {"questions": questions(report)}


def disclosures(form: dict) -> list[str]:
    """What a reader put together, left out and assumed, in words."""
    out = []
    if form.get("joined"):
        out.append(f"{form['joined']:,} lines continue a record")
    if form.get("skipped"):
        out.append(f"{form['skipped']:,} lines are in no record")
    s = form.get("syslog")
    if s:
        if s["year_assumed"]:
            out.append(f"the year is not in the file: {s['year'] or 'none'} is assumed ({s['year_source']})")
        for name, text in (("year_wrapped_records", "records got another year than that"), ("year_ambiguous_records", "records could as well be of another year"), ("undated_records", "records have no year at all")):
            if s[name]:
                out.append(f"{s[name]:,} {text}")
        out += [f"not a record: {x}" for x in s["unmatched_samples"]]
    return out


def _pick(row: dict, *names: str) -> dict:
    return {n: row[n] for n in names}


def _classes(m: Measurement, text: str | None, most: int = 60) -> dict:
    """The top shapes; the number of all of them is exact."""
    if text is None:
        return {"field": None, "distinct": 0, "untemplatable": 0, "untemplatable_share": 0.0, "empty": m.count, "top": []}
    s = m.shapes(text)
    a = s.agg(F.count("shape").alias("distinct"), F.coalesce(F.sum(F.when(F.col("shape").isNull(), F.col("n"))), F.lit(0)).alias("none")).first()
    top = s.filter("shape is not null").orderBy(F.desc("n"), "shape").limit(most).collect()
    return {"field": text, "distinct": a.distinct, "untemplatable": a.none, "untemplatable_share": a.none / m.count if m.count else 0.0, "empty": m.empties(text), "top": [{"shape": r.shape, "records": r.n} for r in top]}


def questions(r: dict) -> list[dict]:
    """Up to six questions, each with its figures and every option that was measured."""
    out = []

    def ask(name: str, question: str, options: list[str], note: str, **figures) -> None:
        out.append({"id": name, "question": question, "evidence": figures, "options": options, "note": note})

    ask("data", "Is this file all of the data?", ["yes", "it is a sample", "other files belong to it"], "All counts are of the records that were read.", path=r["path"], format=r["format"]["kind"], **r["scan"])
    clocks = r["clocks"][:4]
    note = "The order is by how fields behave, not by their names." if clocks else "No field parses as a time, so retention has nothing to measure against. Which field has the time of an event, if any?"
    ask("clock", "Which field is the event clock?", [c["field"] for c in clocks], note, candidates=clocks)
    if r["content"]:
        ask("content", "Which field has the text that people read?", [c["field"] for c in r["content"][:4]], "A field that is mostly empty makes poor content, whatever its name.", candidates=[_pick(c, "field", "fill_rate", "mean_length", "reuse") for c in r["content"][:4]])
    keys = [k for k in r["identity"] if k["verdict"] in VERDICTS][:6]
    if keys:
        note = "Pairs are offered because one field alone, such as a process id, may collide across services."
        if r["coverage"]["is_prefix_of_timeline"]:
            note += " This is a prefix of the timeline: keys may come back later. Rescan without --limit first."
        ask("identity", "Which field identifies a thing that lasts?", [k["candidate"] for k in keys], note, measured=keys, meaning=MEANING)
    c = r["classes"]
    if c["field"]:
        note = f"{c['untemplatable_share']:.0%} of records have no shape. If that is much, the text is free-form, and classes would only list its values."
        ask("classes", "Is this a template corpus?", ["yes, templates", "no, prose"], note, **(c | {"top": c["top"][:6]}))
    if r["health"]["masked"]:
        ask("redaction", "The file is redacted. Which fields are safe as keys?", ["only unmasked fields", "redaction is expected"], "Redacted records share one value; a key on them is a confident wrong answer, not an error.", masked=r["health"]["masked"])
    return out


def render(r: dict) -> str:
    """The report as text."""
    scan, c = r["scan"], r["classes"]
    out = [f"{r['path']}: {r['format']['kind']}, {scan['records']:,} records" + " (TRUNCATED)" * scan["truncated"]]
    if r["format"]["note"]:
        out.append(f"  {r['format']['note']}")
    out += [f"  {x}" for x in disclosures(r["format"])]
    if r["coverage"]["is_prefix_of_timeline"]:
        out.append("  PREFIX OF THE TIMELINE: identity verdicts are indicative. Rescan without --limit.")
    out += ["", "FIELDS"] + table(("field", "kind", "filled", "distinct", "longest", "sample"), [(f["field"], f["kind"], f"{f['fill_rate']:.0%}", f"{f['distinct']:,}", f["max_length"], short(f["samples"][0]) if f["samples"] else "-") for f in r["fields"]])
    out += ["", "CLOCKS"] + table(("field", "read as", "parses", "in order", "days"), [(x["field"], x["strategy"], f"{x['parse_rate']:.0%}", f"{x['monotonic']:.0%}", f"{x['span_s'] / 86400:.2f}") for x in r["clocks"]])
    out += ["", "CONTENT"] + table(("field", "filled", "mean length", "reuse"), [(x["field"], f"{x['fill_rate']:.0%}", f"{x['mean_length']:.1f}", f"{x['reuse']:.2f}") for x in r["content"]])
    out += ["", "IDENTITY"] + table(("key", "verdict", "evidence"), [(x["candidate"], x["verdict"], x["evidence"]) for x in r["identity"][:8]])
    out += ["", f"SHAPES of {c['field'] or 'no field'}: {c['distinct']:,}; {c['untemplatable']:,} records have none, {c['empty']:,} are empty"] + table(("records", "shape"), [(f"{x['records']:,}", short(x["shape"], 90)) for x in c["top"][:8]])
    out += ["", "QUESTIONS FOR THE USER"]
    for i, q in enumerate(r["questions"], 1):
        out += [f"  {i}. {q['question']}", f"     options: {', '.join(q['options']) or 'none'}", f"     {q['note']}"]
    return "\n".join([*out, "", "Nothing above is a schema."])


def table(head: tuple, rows: list[tuple]) -> list[str]:
    """Aligned lines, indented by two."""
    if not rows:
        return ["  none"]
    all_rows = [tuple(map(str, x)) for x in (head, *rows)]
    wide = [max(map(len, col)) for col in zip(*all_rows)]
    return ["  " + "  ".join(x.ljust(w) for x, w in zip(row, wide)).rstrip() for row in all_rows]


def short(v, most: int = 40) -> str:
    s = " ".join(str(v).split())
    return s if len(s) <= most else s[: most - 1] + "…"
