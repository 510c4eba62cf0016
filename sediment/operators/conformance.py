"""Schemas that are wrong in one known way; a validator must reject each for the stated reason."""

from __future__ import annotations

import copy
import json

from ..schema import declared_fields, dump_yaml, load_schema
from .validate import Measurement, validate

GONE = "no_such_field"


def _first_field(s: dict) -> None:
    fields = declared_fields(s)
    if fields:
        fields[0]["path"] = GONE
    else:
        s["record_layers"] = {"payload": [{"path": GONE, "role": "context"}]}


def _bucket(s: dict, facts: dict) -> None:
    mine = [f["path"] for f in declared_fields(s) if f["path"] in facts["buckets"]]
    s["identity_key"] = (mine or facts["buckets"] or ["file"])[0]


def _message(s: dict) -> None:
    mk = s.setdefault("message_key", {})
    mk.setdefault("field", next((f["path"] for f in declared_fields(s) if f.get("role") == "content"), "message"))
    mk["pattern"] = "(never-in-any-log-7f3a)"


def _masked(s: dict, facts: dict) -> tuple[str, str]:
    name = next(iter(facts["masked"]), None)
    if name is None:
        s["identity_key"] = "no_such_masked_field"
        return "identity_key", "no candidate"
    s["identity_key"] = name
    fields = declared_fields(s)
    own = next((f for f in fields if f["path"] == name), None)
    if own:
        own["role"] = "identity"
    else:
        s.setdefault("record_layers", {}).setdefault("envelope", []).append({"path": name, "role": "identity"})
    return "declared_fields_unmasked", "placeholders"


def fixtures(schema: dict, facts: dict) -> list[dict]:
    """name, target, says and schema of the eight fixtures."""
    out = []

    def add(name: str, target: str, says: str, change) -> None:
        s = copy.deepcopy(schema)
        got = change(s)
        out.append({"name": name, "target": got[0] if got else target, "says": got[1] if got else says, "schema": s})

    classes = lambda s: s.setdefault("classes", [{"name": "any", "template": "any", "retention": "keep"}])
    add("field-does-not-exist", "fields_present", "missing", _first_field)
    add("identity-key-is-a-bucket", "identity_key", "not an identifier", lambda s: _bucket(s, facts))
    add("class-matches-nothing", "classes_resolve", "match nothing", lambda s: classes(s).append({"name": "phantom", "template": "zzqx wvut never logged", "retention": "keep"}))
    add("clock-is-not-a-clock", "clock_resolvable", "best clock", lambda s: s.update(time_field="no_such_clock"))
    add("message-pattern-matches-nothing", "message_key", "extracts nothing", _message)
    add("retention-is-unknown", "classes_resolve", "no usable retention", lambda s: classes(s)[0].update(retention="keep-extened"))
    add("identity-key-is-masked", "declared_fields_unmasked", "placeholders", lambda s: _masked(s, facts))
    add("no-identity-key", "identity_key", "identity_key", lambda s: s.pop("identity_key", None) and None)
    return out


def measure_facts(schema: dict, m: Measurement, clock: str | None) -> dict:
    content = {f["path"] for f in declared_fields(schema) if f.get("role") == "content"}
    return {"masked": sorted(n for n, p in m.profiles.items() if p["placeholder_rate"] > 0.9 and n not in content), "buckets": [r["candidate"] for r in m.identity(clock) if r["verdict"] == "bucket" and "+" not in r["candidate"]]}


def write_fixtures(schema: dict, m: Measurement, folder: str, clock: str | None = None) -> dict:
    """One YAML file per fixture, and fixtures.json; the folder is on the driver."""
    import os

    os.makedirs(folder, exist_ok=True)
    index = []
    for f in fixtures(schema, measure_facts(schema, m, clock or schema.get("time_field"))):
        with open(f"{folder}/{f['name']}.yaml", "w") as out:
            out.write(f"# must fail {f['target']}, saying: {f['says']}\n{dump_yaml(f['schema'])}")
        index.append({k: f[k] for k in ("name", "target", "says")} | {"file": f"{f['name']}.yaml"})
    with open(f"{folder}/fixtures.json", "w") as out:
        json.dump(index, out, indent=1)
    return {"fixtures": index}


def judge(schema: dict, target: str, says: str, m: Measurement, clock: str | None) -> str:
    try:
        report = validate(schema, m, clock)
    except Exception as e:  # a fixture that breaks the validator is a finding, not a crash
        return f"unreadable: {e}"
    mine = [r for r in report.results if r.name == target and not r.passed]
    if not mine:
        return "PASSED-BUT-SHOULD-FAIL" if report.ok else "failed-for-the-wrong-reason"
    said = " ".join(r.detail + json.dumps(r.evidence, default=str) for r in mine).lower()
    return "rejected-as-required" if says.lower() in said else "failed-for-the-wrong-reason"


def run_fixtures(m: Measurement, folder: str, clock: str | None = None) -> dict:
    """The outcome of each fixture; all share one measurement."""
    with open(f"{folder}/fixtures.json") as f:
        index = json.load(f)
    schemas = {}
    for x in index:
        with open(f"{folder}/{x['file']}") as f:
            schemas[x["name"]] = load_schema(f.read())
    known = {c["field"] for c in m.clocks}
    clock = clock or next((s["time_field"] for s in schemas.values() if s.get("time_field") in known), None) or (m.clocks[0]["field"] if m.clocks else None)
    got = {x["name"]: judge(schemas[x["name"]], x["target"], x["says"], m, None if schemas[x["name"]].get("time_field") else clock) for x in index}
    return {"outcomes": got, "ok": all(v == "rejected-as-required" for v in got.values())}
