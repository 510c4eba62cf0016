"""Command line: help, project init, inspect, validate, conformance write and run, preview.

Exit codes: 0 good, 1 a claim or a fixture failed, 2 could not run.
"""

from __future__ import annotations

import argparse
import json
import sys

TOPICS = {
    "start": "project init makes a folder; inspect measures a log and asks what only its owner knows; write schema.yaml from the answers.",
    "loop": "validate recomputes every claim of schema.yaml and advises on failures; repeat until it exits with 0, then write and run conformance fixtures and look at a preview.",
}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sediment", description="Measure logs and check schemas of them.")
    verbs = p.add_subparsers(dest="verb")
    h = verbs.add_parser("help", help="list the verbs, or explain a topic")
    h.add_argument("topic", nargs="?", choices=list(TOPICS))
    project = verbs.add_parser("project", help="start a project").add_subparsers(dest="sub", required=True)
    i = project.add_parser("init")
    i.add_argument("--name", required=True)
    i.add_argument("--location", required=True)
    i.add_argument("--force", action="store_true", help="write into a folder that isn't empty")
    i.add_argument("--json", action="store_true")

    def data(v, schema: bool = True, clock: bool = True, as_json: bool = True):
        v.add_argument("path")
        v.add_argument("--limit", type=int, default=200_000, help="records to read; 0 reads all")
        if schema:
            v.add_argument("--schema", required=True)
        if clock:
            v.add_argument("--time-field")
        if as_json:
            v.add_argument("--json", action="store_true")
        return v

    data(verbs.add_parser("inspect", help="measure a log and ask about it"), schema=False, clock=False)
    data(verbs.add_parser("validate", help="check every claim of a schema")).add_argument("--iteration", type=int)
    conformance = verbs.add_parser("conformance", help="schemas that must fail").add_subparsers(dest="sub", required=True)
    data(conformance.add_parser("write"), as_json=False).add_argument("--out", required=True)
    data(conformance.add_parser("run"), schema=False).add_argument("--fixtures", required=True)
    data(verbs.add_parser("preview", help="show events; write nothing"), clock=False).add_argument("-n", type=int, default=20)
    return p


def _schema(path: str) -> dict:
    from .schema import load_schema

    with open(path) as f:
        return load_schema(f.read())


def _run(a: argparse.Namespace, spark) -> tuple[int, dict, str]:
    """(exit code, JSON result, text) of a verb on data."""
    from .operators import conformance
    from .operators.project import preview_summary, project
    from .operators.validate import Measurement, validate
    from .reports import gate, inspection
    from .reports.rounding import rounded
    from .sources.readers import read

    schema = _schema(a.schema) if getattr(a, "schema", None) else None
    sub, records, cut = read(spark, a.path, a.limit or None)
    if a.verb == "preview":
        events = project(schema, records).orderBy("index").limit(a.n).persist()
        shown, summary = [r.asDict(recursive=True) for r in events.collect()], preview_summary(events)
        events.unpersist()
        scanned = records.count()
        shown = rounded(shown)
        return 0, {"path": a.path, "schema": a.schema, "scanned": scanned, "truncated": cut, "summary": summary, "events": shown}, gate.render_preview(shown, summary, scanned, cut, a.path, a.schema)
    m = Measurement(records, hit_limit=cut, kept=bool(a.limit))
    try:
        if a.verb == "inspect":
            r = inspection.inspect(m, sub, a.limit or None)
            return 0, r, inspection.render(r)
        if a.verb == "validate":
            d = gate.validation_dict(validate(schema, m, a.time_field), a.path, a.schema, a.iteration)
            return 0 if d["ok"] else 1, d, gate.render_validation(d)
        if a.sub == "write":
            d = conformance.write_fixtures(schema, m, a.out, a.time_field)
            return 0, d, f"wrote {len(d['fixtures'])} fixtures to {a.out}"
        d = conformance.run_fixtures(m, a.fixtures, a.time_field)
        return 0 if d["ok"] else 1, d, gate.render_conformance(d)
    finally:
        m.close()


def main(argv: list[str] | None = None, spark=None) -> int:
    p = build_parser()
    a = p.parse_args(argv)
    if a.verb in (None, "help"):
        print(TOPICS[a.topic] if getattr(a, "topic", None) else p.format_help())
        return 0
    try:
        if a.verb == "project":
            from .reports.scaffold import init_project

            d = init_project(a.name, a.location, a.force)
            code, text = 0, "\n".join([f"wrote to {d['root']}:", *(f"  {x}" for x in d["written"])])
        else:
            from py4j.protocol import Py4JJavaError
            from pyspark.errors import AnalysisException

            try:
                code, d, text = _run(a, spark or _session())
            except AnalysisException as e:
                raise FileNotFoundError(str(e).splitlines()[0]) from e
            except Py4JJavaError as e:  # the file system's own error
                if "java.io" not in str(e.java_exception):
                    raise
                raise FileNotFoundError(str(e.java_exception).splitlines()[0]) from e
    except (OSError, ValueError) as e:
        print(f"sediment: {e}", file=sys.stderr)
        return 2
    print(json.dumps(d, indent=1, default=str, sort_keys=True) if getattr(a, "json", False) else text)
    return code


def _session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("sediment").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    sys.exit(main())
