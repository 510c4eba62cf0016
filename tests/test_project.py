"""Notes, states and names of projected events."""

from sediment.operators.project import project

SCHEMA = {
    "identity_key": "pid",
    "record_layers": {"envelope": [{"path": "pid", "role": "identity"}], "payload": [{"path": "tok", "role": "content"}]},
    "classes": [{"name": "connect", "template": "connect from <HOST>", "retention": "keep"}],
}


def test_notes(spark):
    rows = [(0, "7", "connect from <HOST>", "2024-01-01T00:00:00"), (1, "<HEX1>", "never seen", None), (2, None, None, None)]
    got = project(SCHEMA, spark.createDataFrame(rows, "pos long, pid string, tok string, stamp string")).orderBy("index").collect()
    notes = [" / ".join(e["notes"]) for e in got]
    assert [e["class"]["name"] for e in got] == ["connect", None, None]
    assert "redacted component" in notes[1] and "redacted component" not in notes[0]
    assert all("fallback" in n for n in notes)
    assert "no declared class" in notes[1] and "no declared class" not in notes[0]
    timed = project(SCHEMA | {"time_field": "stamp"}, spark.createDataFrame(rows, "pos long, pid string, tok string, stamp string")).orderBy("index").collect()
    assert [e["wall"]["precision"] for e in timed] == ["exact", "unresolved", "unresolved"] and not any("fallback" in n for e in timed for n in e["notes"])


def test_a_frequent_shape_is_no_task_of_its_own(spark):
    rows = [(i, "7", "connect from <HOST>", None) for i in range(50)]
    schema = SCHEMA | {"classes": [{"name": None, "template": "from"}, *SCHEMA["classes"], {"name": "none", "template": " "}]}
    df = spark.createDataFrame(rows, "pos long, pid string, tok string, stamp string")
    for s, name in ((SCHEMA, "connect"), (schema, None), (SCHEMA | {"classes": []}, None)):
        e = project(s, df)
        assert {r[0] for r in e.select("class.name").collect()} == {name}
        plan = e._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "hashpartitioning" not in plan
