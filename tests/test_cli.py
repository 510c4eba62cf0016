"""The command line, its reports and the project scaffold, on files written here."""

import json

import pytest

from sediment.__main__ import main
from sediment.reports.inspection import inspect_path, render
from sediment.schema import dump_yaml

from test_validate import SCHEMA, corpus


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    rows = [r | {"tok": f"{r['tok']} after {r['pid']} tries"} for r in corpus()]
    (d / "mail.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (d / "schema.yaml").write_text(dump_yaml(SCHEMA))
    (d / "wrong.yaml").write_text(dump_yaml(SCHEMA | {"identity_key": "svc"}))
    return d


def test_inspect(spark, files):
    r = inspect_path(spark, str(files / "mail.jsonl"))
    assert [q["id"] for q in r["questions"]] == ["data", "clock", "content", "identity", "classes", "redaction"]
    assert r["clocks"][0]["field"] == "stamp" and r["classes"]["field"] == "tok" and r["classes"]["distinct"] == 4
    assert {k["candidate"]: k["verdict"] for k in r["identity"]}["pid"] == "session"
    assert [x["field"] for x in r["health"]["masked"]][0] == "q"
    assert len(r["questions"][3]["options"]) <= 6 and not r["scan"]["truncated"]
    text = render(r)
    assert "QUESTIONS FOR THE USER" in text and "Nothing above is a schema" in text and "confident wrong answer" in text
    assert json.dumps(r, default=str, sort_keys=True) == json.dumps(inspect_path(spark, str(files / "mail.jsonl")), default=str, sort_keys=True)


def test_a_cut_scan_says_so(spark, files, capsys):
    assert main(["inspect", str(files / "mail.jsonl"), "--limit", "100"], spark) == 0
    text = capsys.readouterr().out
    assert "TRUNCATED" in text and "PREFIX OF THE TIMELINE" in text and "Rescan without --limit" in text


def test_no_clock_and_prose(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("".join(json.dumps({"a": f"word{i}", "b": "z"}) + "\n" for i in range(30)))
    r = inspect_path(spark, str(p))
    assert not r["clocks"] and "nothing to measure against" in r["questions"][1]["note"]


def test_validate_exit_codes(spark, files, capsys):
    data, good, bad = (str(files / n) for n in ("mail.jsonl", "schema.yaml", "wrong.yaml"))
    assert main(["validate", data, "--schema", good, "--json", "--iteration", "3"], spark) == 0
    d = json.loads(capsys.readouterr().out)
    assert d["ok"] and len(d["predicates"]) == 8 and d["iteration"] == 3 and not d["advice"]
    assert main(["validate", data, "--schema", bad], spark) == 1
    assert "bucket" in capsys.readouterr().out
    assert main(["validate", data, "--schema", str(files / "none.yaml")], spark) == 2
    assert main(["validate", str(files / "none.jsonl"), "--schema", good], spark) == 2


def test_conformance(spark, files, capsys):
    data, out = str(files / "mail.jsonl"), str(files / "fixtures")
    assert main(["conformance", "write", data, "--schema", str(files / "schema.yaml"), "--out", out], spark) == 0
    assert main(["conformance", "run", data, "--fixtures", out], spark) == 0
    assert "8 of 8" in capsys.readouterr().out


def test_disclosures(spark, tmp_path, capsys):
    """What a syslog reader assumed and left out stands in the report."""
    p = tmp_path / "maillog-20260103"
    p.write_text("stray\n" + "".join(f"Dec 31 23:59:{i:02d} mx1 cron[{i % 3}]: job {i} done\n  and more\n" for i in range(30)) + "Jan  1 00:00:03 mx1 cron[7]: last\n")
    assert main(["inspect", str(p), "--json"], spark) == 0
    s = json.loads(capsys.readouterr().out)["format"]
    assert (s["read"], s["joined"], s["skipped"]) == (31, 30, 1) and s["syslog"]["year_wrapped_records"] == 30 and s["syslog"]["unmatched_samples"] == ["stray"]
    assert main(["inspect", str(p)], spark) == 0
    text = capsys.readouterr().out
    assert "2026 is assumed (rotation-suffix)" in text and "30 records got another year" in text and "not a record: stray" in text and "30 lines continue a record" in text


def test_absorbed_shapes_are_reported(spark, files, capsys):
    assert main(["validate", str(files / "mail.jsonl"), "--schema", str(files / "schema.yaml"), "--json"], spark) == 0
    d = json.loads(capsys.readouterr().out)
    matched = next(p for p in d["predicates"] if p["name"] == "classes_resolve")["evidence"]["matched"]
    assert [m["name"] for m in matched] == ["connect", "disconnect", "queue", "accepted"] and all(m["records"] == 400 and len(m["shortest_shapes"]) == m["shapes"] for m in matched)


def test_preview(spark, files, capsys):
    args = ["preview", str(files / "mail.jsonl"), "--schema", str(files / "schema.yaml"), "-n", "7"]
    assert main(args, spark) == 0
    text = capsys.readouterr().out
    assert "Nothing was written" in text and "canonical_name" in text and "7 of 1,600" in text
    assert main([*args, "--json"], spark) == 0
    d = json.loads(capsys.readouterr().out)
    assert [e["index"] for e in d["events"]] == list(range(7)) and d["summary"]["shown"] == 7


def test_scaffold(tmp_path, capsys):
    args = ["project", "init", "--name", "p", "--location", str(tmp_path)]
    assert main([*args, "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)["written"]) == 7 and (tmp_path / "p/conformance/.gitkeep").exists()
    assert main(args) == 2 and main([*args, "--force"]) == 0


def test_help(capsys):
    assert main([]) == 0 and main(["help", "loop"]) == 0
    assert "validate" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["doctor"])
