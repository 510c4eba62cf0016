"""Validation, conformance and preview as text and JSON."""

from __future__ import annotations

from dataclasses import asdict

from ..operators.validate import Report, Result
from .inspection import short, table
from .rounding import rounded

# What to do about each kind of failure.
ADVICE = {
    "fields_present": "check the spelling and the layer of the field; a dotted path can't resolve in flat records",
    "declared_fields_unmasked": "records collapse onto the placeholders; choose a key that isn't redacted",
    "identity_key": "a session is a burst, an entity lasts, a bucket is a category, noise identifies nothing; choose a session or an entity",
    "message_key": "try the pattern, with one group for the id, on a few lines of the field",
    "classes_resolve": "copy shapes as inspect reports them, and use a known retention",
    "clock_resolvable": "declare the field that inspect ranks first; without a clock, retention has nothing to measure against",
}


def advise(r: Result) -> list[str]:
    """Next actions for one failed predicate, from its own evidence."""
    ev, out = r.evidence, [r.detail]
    out += [f"missing: {', '.join(ev['missing'])}"] if ev.get("missing") else []
    out += [f"redacted: {', '.join(ev['masked'])}"] if ev.get("masked") else []
    out += [f"{k['candidate']}: {k['verdict']}" for k in ev.get("measured", [])[:5]]
    out += [f"class {u['name']}: {u['reason']}" for u in ev.get("unmatched", [])[:6]]
    if r.name == "every_record_classed":
        many, once = ev["residue_shapes"], ev["residue_shapes_seen_once"]
        out.append(f"{ev['residue_records']:,} records of {many:,} shapes are outside every class; {once:,} shapes occur once")
        out.append("mostly a long tail: look at them before you declare them" if 2 * once > many else "these recur: declare them from the shapes that inspect reports")
        out += [f"{t['records']:,}  {short(t['shape'], 60)}" for t in ev["residue_top_shapes"][:5]]
    return out + [ADVICE[r.name]] * (r.name in ADVICE)


def validation_dict(rep: Report, path: str, schema: str, iteration: int | None = None) -> dict:
    bad = rep.failures()
    return {"path": path, "schema": schema, "iteration": iteration, "ok": rep.ok, "coverage": rep.coverage, "predicates": rounded([asdict(r) for r in rep.results]), "fatal": [r.name for r in bad if r.fatal], "advice": {r.name: advise(r) for r in bad}}


def render_validation(d: dict) -> str:
    good = sum(p["passed"] for p in d["predicates"])
    out = [f"{d['path']} against {d['schema']}: {'VALID' if d['ok'] else 'NOT VALID'}, {good} of {len(d['predicates'])}"]
    if d["coverage"]["is_prefix_of_timeline"]:
        out.append("  PREFIX OF THE TIMELINE: Rescan without --limit")
    out += table(("result", "predicate", "detail"), [("pass" if p["passed"] else "FAIL", p["name"], p["detail"]) for p in d["predicates"]])
    for name, lines in d["advice"].items():
        out += ["", f"{name}:"] + [f"  {x}" for x in lines]
    return "\n".join(out)


def render_conformance(got: dict) -> str:
    good = sum(v == "rejected-as-required" for v in got["outcomes"].values())
    return "\n".join([f"{good} of {len(got['outcomes'])} wrong schemas rejected as required", *table(("fixture", "outcome"), list(got["outcomes"].items()))])


def render_preview(events: list[dict], summary: dict, scanned: int, cut: bool, path: str, schema: str) -> str:
    out = [f"{path} through {schema}: {len(events)} of {scanned:,} records" + " (TRUNCATED)" * cut]
    rows = [(e["index"], e["wall"]["time"] or "-", e["wall"]["precision"], short(e["identity"]["canonical_name"] or "-", 30), e["class"]["name"] or "(unclassified)", short("; ".join(e["notes"]), 60)) for e in events]
    out += table(("#", "time", "precision", "canonical_name", "class", "notes"), rows)
    out += ["", "SUMMARY", f"  identities {summary['identities']:,}; mostly redacted {summary['redacted']}; without a clock {summary['unresolved']}"]
    out += table(("records", "class"), [(n, c or "(unclassified)") for c, n in sorted(summary["classes"].items(), key=lambda x: (-x[1], x[0] or ""))])
    if events:
        shown = [(f["path"], *(short(v if v is not None else "-") for v in f["state"].values())) for f in events[0]["fields"][:14]]
        out += ["", "FIELDS OF THE FIRST EVENT"] + table(("field", *(events[0]["fields"][0]["state"] if shown else ())), shown)
    return "\n".join([*out, "", "Nothing was written."])
