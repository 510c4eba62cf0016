"""Readers, schemas, predicates and fixtures on a corpus whose verdicts are known by construction."""

import datetime as dt
import json

import pytest

from sediment.operators import conformance
from sediment.operators.validate import Measurement, build_classifier, validate
from sediment.schema import YamlError, dump_yaml, parse_yaml
from sediment.sources import readers
from sediment.sources.detect import detect, sniff_syslog

KINDS = ["connect from <HOST>", "disconnect from <HOST>", "queue active size 12", "message accepted 250"]


def corpus():
    t0, rows = dt.datetime(2023, 11, 14, 22, 13, 20), []
    for s in range(40):
        for k in range(40):
            rows.append({"stamp": (t0 + dt.timedelta(seconds=2 * (40 * s + k))).isoformat(), "svc": "qmgr" if s % 4 == 0 else "smtpd", "pid": 1000 + s, "q": f"<HEX{k % 3}>", "tok": f"{KINDS[k % 4]}", "file": "maillog"})
    return rows


SCHEMA = {
    "identity_key": "pid",
    "time_field": "stamp",
    "record_layers": {"envelope": [{"path": "stamp", "role": "context"}, {"path": "pid", "role": "identity"}, {"path": "svc", "role": "context"}], "payload": [{"path": "tok", "role": "content"}]},
    "classes": [{"name": "connect", "template": "connect from <HOST>", "retention": "keep"}, {"name": "disconnect", "template": "disconnect from <HOST>", "retention": "drop"}, {"name": "queue", "template": "queue active size <N>", "retention": "demote"}, {"name": "accepted", "template": "message accepted", "retention": "keep-extended"}],
}


@pytest.fixture(scope="module")
def measured(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("log") / "mail.jsonl"
    p.write_text("".join(json.dumps(r) + "\n" for r in corpus()))
    sub, records, hit = readers.read(spark, str(p))
    assert sub.kind == "jsonl" and not hit and records.count() == 1600
    assert [r.pos for r in records.orderBy("pos").limit(3).collect()] == [0, 1, 2]
    return Measurement(records)


def test_a_true_schema_passes(measured):
    report = validate(SCHEMA, measured)
    assert report.ok, [(r.name, r.detail) for r in report.failures()]
    assert len(report.results) == 8


def test_fixtures_are_rejected_for_their_reason(measured, tmp_path):
    conformance.write_fixtures(SCHEMA, measured, str(tmp_path))
    got = conformance.run_fixtures(measured, str(tmp_path))
    assert len(got["outcomes"]) == 8 and got["ok"], got


def test_a_prefix_cannot_establish_identity(measured):
    m = Measurement(measured.records, hit_limit=True)
    bad = {r.name: r.detail for r in validate(SCHEMA, m).failures()}
    assert "prefix of the timeline" in bad["identity_key"]


def test_classifier(measured):
    out, report = build_classifier(SCHEMA, measured.records)
    assert report["seen"] == report["classified"] == 1600 and {r[0] for r in out.select("class").distinct().collect()} == {"connect", "disconnect", "queue", "accepted"}


def test_yaml_round_trip_and_refusals():
    assert parse_yaml(dump_yaml(SCHEMA)) == SCHEMA
    assert parse_yaml("a: [1, 'x, y', null]\nb:\n- c: yes # note\n  d: 1.5\n- {e: f}\n") == {"a": [1, "x, y", None], "b": [{"c": True, "d": 1.5}, {"e": "f"}]}
    for bad in ("a: |\n  x", "---\na: 1", "a:\n\tb: 1", "a: 1\n  b: 2", "just text"):
        with pytest.raises(YamlError):
            parse_yaml(bad)


def test_detection():
    kind = lambda name, text: detect(name, text.encode()).kind
    bsd = "Oct  3 03:27:45 mx1 postfix/smtpd[17810]: connect\n"
    assert kind("x.json", '{"a":1}\n{"a":2}\n') == "jsonl" and kind("x.json", '[{"a":1}]') == "json" and kind("x.csv", "a,b\n1,2\n") == "delimited"
    assert kind("maillog", bsd * 5) == "syslog" and kind("x.log", "hello there\nworld\n") == "text" and sniff_syslog(bsd * 2) == "bsd"
    assert "mixed syslog dialects" in detect("x.log", (bsd + "<134>1 2026-09-27T03:27:45Z h a 1 - - m\n").encode()).note
    with pytest.raises(ValueError):
        detect("x.log", b" \n")


def test_other_readers(spark, tmp_path):
    (tmp_path / "maillog-20261003").write_text("stray\nOct  3 03:27:45 mx1 postfix/smtpd[17810]: connect\n  at line 1\nOct  3 03:27:46 mx1 cron: done\n")
    sub, d, _ = readers.read(spark, str(tmp_path / "maillog-20261003"), sub=detect("maillog", ("Oct  3 03:27:45 mx1 cron: done\n" * 5).encode()))
    rows = d.orderBy("pos").collect()
    assert [(r.stamp, r.ident, r.pid, r.message) for r in rows] == [("2026-10-03T03:27:45", "postfix/smtpd", "17810", "connect\nat line 1"), ("2026-10-03T03:27:46", "cron", "", "done")]
    (tmp_path / "x.csv").write_text("a, b\n1,2\n3\n")
    _, d, _ = readers.read(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in d.orderBy("pos").collect()] == [(0, "1", "2"), (1, "3", None)]
    (tmp_path / "y.jsonl").write_text('prose\n{"a": 1,\n "b": {"c": 2}}\n{"a": true}\n')
    _, d, _ = readers.read(spark, str(tmp_path / "y.jsonl"))
    assert [(r.a, json.loads(r.b) if r.b else None) for r in d.orderBy("pos").collect()] == [("1", {"c": 2}), ("True", None)]
    (tmp_path / "z.json").write_text('{"records": [{"a": 1}, {"a": 2}]}')
    _, d, hit = readers.read(spark, str(tmp_path / "z.json"), limit=1)
    assert hit and d.count() == 1
