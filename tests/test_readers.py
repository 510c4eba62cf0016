"""Readers over splits of any size, and what they disclose."""

import json
import random

import pytest

from sediment.operators.cells import cells
from sediment.operators.profile import content_rank, dominant_kinds, profile_fields
from sediment.sources import readers, syslog
from sediment.sources.detect import Substrate, detect
from sediment.sources.jsonrecords import TYPES, Assembler


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def sequential(lines):
    """Records, joined and skipped lines by a character at a time."""
    out, joined, skipped, buf, depth, quoted, escaped = [], 0, 0, [], 0, False, False
    for line in lines:
        if not line.strip():
            continue
        if not buf and line.strip()[0] not in "{[":
            skipped += 1
            continue
        buf.append(line)
        for ch in line + "\n":
            if quoted:
                if escaped:
                    escaped = False
                elif ch == "\\":
                    escaped = True
                elif ch == '"':
                    quoted = False
            elif ch == '"':
                quoted = True
            else:
                depth += (ch in "{[") - (ch in "]}")
        if len(buf) > 1000 or sum(len(b) + 1 for b in buf) > 1_000_000:
            skipped += len(buf)
        elif depth <= 0:
            try:
                v = json.loads("\n".join(buf))
            except ValueError:
                v = None
            if isinstance(v, dict):
                out.append(v)
                joined += len(buf) - 1
            else:
                skipped += len(buf)
        else:
            continue
        buf, depth, quoted, escaped = [], 0, False, False
    return out, joined, skipped + len(buf)


def some_lines(seed, n=300):
    rng, out = random.Random(seed), []
    for i in range(n):
        v = {"i": i}
        if i % 5 == 0:
            v["rare"] = rng.choice([1, 1.5, True, None, "", " ", "x{[", 'q"\\', "é😀", [1, {"a": 2}], {"b": None}, "Z" * 90])
        if i % 3 == 0:
            v["Case"], v["case"], v["pos"] = i, str(i), -i
        out += json.dumps(v, indent=rng.choice([None, None, None, 1]), ensure_ascii=rng.random() < 0.5).split("\n")
        out += rng.choice([[], [], [], ["stray"], ["", "\t  "], ["{bad}"], ["[1, 2]"], ["}"], ['{"open": "', 'x"}'], ["{"]])
    return out


@pytest.mark.parametrize("seed", [0, 1, 3])
def test_jsonl_in_splits(spark, tmp_path, small_splits, seed):
    lines = some_lines(seed)
    if seed == 3:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        lines.insert(40, '{"long": "' + "y" * 1_000_000 + '"}')
        lines.insert(90, '{"wide": "' + "y" * 900 + '"}')
    want, joined, skipped = sequential(lines)
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    sub = Substrate("jsonl", str(p))
    d = readers.read_jsonl(spark, str(p), sub)
    assert (sub.read, sub.joined, sub.skipped) == (len(want), joined, skipped)
    rows = d.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(want)))
    names = {"Case": "Case", "case": "case (2)", "pos": "pos (2)"}
    for r, v in zip(rows, want):
        assert r[TYPES] == {names.get(k, k): {str: "str" if str(x).strip() else "empty-string", bool: "bool", int: "int", float: "float", type(None): "null"}.get(type(x), "structured") for k, x in v.items()}
        for k, x in v.items():
            got = r[names.get(k, k)]
            assert got == x if isinstance(x, str) or x is None else json.loads(got) == x if isinstance(x, (list, dict)) else got == str(x)


def test_escapes_at_line_ends():
    for lines in (['{"a": "x\\', 'y"}', '{"b": 1}'], ['{"a": "x\\\\', '"}', '{"b": 1}'], ['{"a": "\\"{"}', '{"b": 1}']):
        a = Assembler()
        got = [r for r in map(a.feed, lines) if r is not None]
        want, joined, skipped = sequential(lines)
        assert got == want and (a.joined, a.skipped + len(a.held)) == (joined, skipped)


def test_presence_and_kinds(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("prose\n" + "".join(json.dumps({"n": i, "f": i / 4, "s": f"word{i % 3} said", "b": i % 2 == 0} | ({"few": "v"} if i % 10 == 0 else {})) + "\n" for i in range(50)))
    c = cells(readers.read_jsonl(spark, str(p)), "pos").persist()
    got = {r.field: (r.present, r.fill_rate) for r in profile_fields(c).collect()}
    assert got["few"] == (5, 1.0) and got["n"] == (50, 1.0)
    assert {r.field: r.kind for r in dominant_kinds(c).collect()} == {"n": "int", "f": "float", "s": "str", "b": "bool", "few": "str"}
    assert {r.field for r in content_rank(c).collect()} == {"s", "few"}
    c.unpersist()


def test_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"meta": 1, "items": [{"a": 1, "b": None}, 5, {"a": "1"}, {"c": [1]}]}, indent=2))
    sub, d, _ = readers.read(spark, str(tmp_path / "x.json"))
    assert [(r.pos, r.a, r.c, r[TYPES]) for r in d.orderBy("pos").collect()] == [(0, "1", None, {"a": "int", "b": "null"}), (1, "1", None, {"a": "str"}), (2, None, "[1]", {"c": "structured"})]
    (tmp_path / "y.json").write_text('{"a": 1}')
    assert readers.read(spark, str(tmp_path / "y.json"))[1].count() == 0


def test_delimited_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,,"x ""y"""\n2,"",z,9\n3\n')
    d = readers.read(spark, str(tmp_path / "x.csv"))[1]
    assert [tuple(r) for r in d.orderBy("pos").collect()] == [(0, "1", "", 'x "y"'), (1, "2", "", "z"), (2, "3", None, None)]
    (tmp_path / "y.csv").write_text('a,b\n1,"two\nlines"\n2,z\n')
    d = readers.read(spark, str(tmp_path / "y.csv"))[1]
    assert [tuple(r) for r in d.orderBy("pos").collect()] == [(0, "1", "two\nlines"), (1, "2", "z")]


def test_text_lines_and_limit(spark, tmp_path, small_splits):
    p = tmp_path / "x.log"
    p.write_bytes("".join(f"line {i} é\n\t \n\n" for i in range(100)).encode() + b"bad \xff byte\n")
    sub, d, more = readers.read(spark, str(p), limit=30)
    assert more and [r.message for r in d.orderBy("pos").collect()] == [f"line {i} é" for i in range(30)]
    assert readers.read(spark, str(p), limit=101)[2] is False
    assert readers.read(spark, str(p))[1].filter("pos = 100").first().message == "bad � byte"


def joined_lines(lines, starts):
    """Records as (first line's place, text), and left lines, in one pass."""
    out, left, runs = [], [], None
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if starts(line):
            out.append([i, line])
            runs = 0
        elif runs is not None and runs < 200:
            out[-1][1] += "\n" + line.strip()
            runs += 1
        else:
            runs = None
            left.append(i)
    return [tuple(x) for x in out], left


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_continuations_in_chunks(spark, monkeypatch, chunk):
    from pyspark.sql import functions as F

    monkeypatch.setattr(syslog, "_CHUNK", chunk)
    rng = random.Random(chunk)
    files = {f: [rng.choice(["S start", "  tail ", "\ttab", "\t ", "", "more"]) for _ in range(120)] for f in ("a", "b")}
    files["c"] = ["before"] + ["S one"] + [f"t{i}" for i in range(450)] + ["S two", "end"]
    d = spark.createDataFrame([(f, i, x) for f, lines in files.items() for i, x in enumerate(lines)], "file string, pos long, line string")
    rec, left = syslog.join_continuations(d, F.col("line").startswith("S"))
    got, rest = rec.collect(), left.collect()
    for f, lines in files.items():
        want, bad = joined_lines(lines, lambda x: x.startswith("S"))
        assert sorted((r.pos, r.line) for r in got if r.file == f) == want
        assert [r.ordinal for r in sorted(got, key=lambda r: r.pos) if r.file == f] == list(range(len(want)))
        assert sorted(r.pos for r in rest if r.file == f) == bad


def test_syslog_disclosure(spark, tmp_path):
    text = "stray\n\t\nDec 31 23:59:58 mx1 cron: a\n at 1\n at 2\nJan  1 00:00:03 mx1 cron[7]: b\nJul  4 10:00:00 mx1 cron: c\n"
    p = tmp_path / "maillog-20260103"
    p.write_text(text)
    sub, d, _ = readers.read(spark, str(p), sub=Substrate("syslog", str(p), dialect="bsd"))
    assert [(r.pos, r.stamp, r.message) for r in d.orderBy("pos").collect()] == [(0, "2025-12-31T23:59:58", "a\nat 1\nat 2"), (1, "2026-01-01T00:00:03", "b"), (2, "2026-07-04T10:00:00", "c")]
    s = sub.syslog
    assert (s["year"], s["year_source"], s["year_assumed"], s["year_wrapped_records"], s["year_ambiguous_records"], s["unmatched_lines"], s["joined_continuation_lines"], s["unmatched_samples"]) == (2026, "rotation-suffix", True, 1, 1, 1, 2, ["stray"])
    q = tmp_path / "maillog"
    q.write_text("Dec 31 23:59:58 mx1 cron: a\n" * 5)
    sub, _, _ = readers.read(spark, str(q))
    assert sub.kind == "syslog" and sub.syslog["year_source"] == "file-mtime" and sub.read == 5


def test_only_the_head_is_read(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    with p.open("wb") as f:
        f.write(b'{"a": 1}\n{"a": 2}\n')
        f.truncate(3 << 30)  # a hole: no disk is used
    head, whole = readers.head_of(spark, str(p))
    assert len(head) == 65_536 and not whole and detect(str(p), head, whole).kind == "jsonl"
    with pytest.raises(FileNotFoundError):
        readers.head_of(spark, str(tmp_path / "none"))
    with pytest.raises(IsADirectoryError):
        readers.head_of(spark, str(tmp_path))
