"""A schema's claims, recomputed from the data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clock_micros, non_empty
from ..schema import RETENTION, content_field, declared_classes, declared_fields, identity_key
from .cells import cells, columns_of
from .clock import rank_clocks
from .identity import evidence, measure, pair_candidates, rank_of
from .profile import profile_fields, value_shapes
from .project import message_id_stats
from .shapes import absorbed, matches, owners, residue, shape_counts, templates

COVERAGE, SHOWN, SHOWN_SHAPES = 0.90, 12, 20


@dataclass
class Result:
    name: str
    passed: bool
    detail: str
    evidence: dict = field(default_factory=dict)
    fatal: bool = False


@dataclass
class Report:
    ok: bool
    results: list[Result]
    coverage: dict

    def failures(self) -> list[Result]:
        return [r for r in self.results if not r.passed]


class Measurement:
    """What is true of the data whatever a schema claims; each fact is computed once and kept.

    kept: hold the records themselves too, in memory and on disk; for a whole
    large file they should be read again instead.
    """

    def __init__(self, records: DataFrame, pos: str = "pos", hit_limit: bool = False, kept: bool = True):
        self.records, self.pos, self.hit_limit, self.kept = records.persist() if kept else records, pos, hit_limit, kept
        self.names = columns_of(records, pos)
        self.cells = cells(self.records, pos, self.names)
        self._kept: dict = {}

    def close(self) -> None:
        for df in (self.records, *(v for v in self._kept.values() if isinstance(v, DataFrame))):
            df.unpersist()

    def _once(self, key, make):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    @property
    def count(self) -> int:
        return self._once("count", self.records.count)

    @property
    def profiles(self) -> dict[str, dict]:
        return self._once("profiles", lambda: {r.field: r.asDict() for r in profile_fields(self.cells).collect()})

    @property
    def clocks(self) -> list[dict]:
        return self._once("clocks", lambda: [r.asDict() for r in rank_clocks(self.cells).orderBy("rank").collect()])

    def identity(self, clock: str | None) -> list[dict]:
        """Single fields and the best pairs, ranked; pairs cut so that about a dozen candidates remain."""

        def make():
            records, t = self.records, None
            if clock in self.names:
                t, records = F.col("record: time"), self._timed(clock)
            shapes = {r.field: r.shape for r in value_shapes(self.cells).collect()}
            run = lambda keys, s=None: [r.asDict() for r in measure(records, keys, t, self.hit_limit, s).orderBy(rank_of(F.col("verdict")), F.desc("mean_size"), "candidate").collect()]
            singles = run([(n,) for n in self.names], shapes)
            pairs = pair_candidates(singles, self.count)
            return singles + (run(pairs)[: max(2, SHOWN - len(singles))] if pairs else [])

        return self._once(("identity", clock), make)

    def _timed(self, clock: str) -> DataFrame:
        """Records with the clock read, which is costly: once, where records are kept."""

        def make():
            df = self.records.withColumn("record: time", clock_micros(F.col(f"`{clock}`").cast("string")))
            return df.persist() if self.kept else df

        return self._once(("timed", clock), make)

    def shapes(self, content: str) -> DataFrame:
        return self._once(("shapes", content), lambda: shape_counts(self.records, content).persist())

    def empties(self, content: str) -> int:
        c = F.col(f"`{content}`").cast("string")
        return self._once(("empties", content), lambda: self.records.filter(~F.coalesce(non_empty(c), F.lit(False))).count())


def validate(schema: dict, m: Measurement, time_hint: str | None = None) -> Report:
    """All predicates, in their order; the report is good if every one passes."""
    partial = m.hit_limit
    clock = time_hint or schema.get("time_field")
    results = [*_fields(schema, m), _identity(schema, m, clock, partial), _message_key(schema, m), *_classes(schema, m), _clock(schema, m, time_hint)]
    results.append(Result("deterministic", True, "a function of schema and data: every order has a tie-break"))
    why = "the scan is a prefix of the timeline; Rescan without --limit" if partial else "whole file"
    return Report(all(r.passed for r in results), results, {"records": m.count, "is_prefix_of_timeline": partial, "explanation": why})


def _fields(schema: dict, m: Measurement):
    seen = set(m.names)
    paths = declared_fields(schema)
    missing = [f["path"] for f in paths if f["path"] not in seen and f["path"].split(".")[0] not in seen]
    yield Result("fields_present", not missing, f"{len(paths)} declared, {len(missing)} missing", {"missing": missing, "observed": sorted(seen)}, True)
    masked = [f["path"] for f in paths if f["path"] not in missing and f.get("role") == "identity" and m.profiles.get(f["path"].split(".")[0], {}).get("placeholder_rate", 0) > 0.9]
    yield Result("declared_fields_unmasked", not masked, f"{len(masked)} identity fields are almost entirely placeholders" if masked else "no identity field is dominated by placeholders", {"masked": masked})


def _identity(schema: dict, m: Measurement, clock: str | None, partial: bool) -> Result:
    key = identity_key(schema)
    if not key:
        return Result("identity_key", False, "the schema names no identity_key", {}, True)
    if partial:
        return Result("identity_key", False, "can't be established from a prefix of the timeline; Rescan without --limit", {"claimed": key}, True)
    found = m.identity(clock)
    mine = next((r for r in found if set(r["candidate"].split("+")) == set(key.split("+"))), None)
    if mine is None:
        return Result("identity_key", False, f"the schema claims {key} but there is no candidate of those fields", {"claimed": key, "measured": found[:6]}, True)
    if mine["verdict"] not in ("session", "entity"):
        return Result("identity_key", False, f"{key} measures as {mine['verdict']}, which is not an identifier: {evidence(mine)}", mine, True)
    return Result("identity_key", True, f"{key} measures as {mine['verdict']}: {evidence(mine)}", mine)


def _message_key(schema: dict, m: Measurement) -> Result:
    mk = schema.get("message_key")
    if not mk:
        return Result("message_key", True, "none declared")
    name, pattern = mk.get("field"), mk.get("pattern")
    if not name or not pattern:
        return Result("message_key", False, "message_key needs a field and a pattern", dict(mk), True)
    if name not in m.names:
        return Result("message_key", False, f"field {name!r} is not in the data", dict(mk), True)
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        return Result("message_key", False, f"the pattern does not compile: {e}", dict(mk), True)
    if groups != 1:
        return Result("message_key", False, f"the pattern needs exactly one group, it has {groups}", dict(mk), True)
    s = m._once(("message", name, pattern), lambda: message_id_stats(m.records, name, pattern).first().asDict())
    return Result("message_key", s["records_with_id"] > 0, f"{s['distinct_ids']} ids in {s['records_with_id']} records" if s["records_with_id"] else "the pattern extracts nothing", s)


def _classes(schema: dict, m: Measurement):
    classes, content = declared_classes(schema), content_field(schema)
    if not classes:
        yield Result("classes_resolve", False, "the schema declares no classes", {}, True)
        return
    if not content or content not in m.names:
        if not content:
            yield Result("classes_resolve", False, "no field has role: content", {}, True)
            return
    bad = [c.get("name") for c in classes if c.get("retention") not in RETENTION]
    if bad:
        yield Result("classes_resolve", False, f"{len(bad)} of {len(classes)} classes have no usable retention", {"bad_retention": bad, "allowed": list(RETENTION)}, True)
        return
    key = ("classes", content, *((str(c.get("name")), str(c.get("template")), c.get("template") is None) for c in classes))
    yield from m._once(key, lambda: list(_matched_classes(classes, content, m)))


def _matched_classes(classes: list[dict], content: str, m: Measurement):
    """Which shapes the classes match, and how many records that covers."""
    spark = m.records.sparkSession
    if content in m.names:
        shapes, empties = m.shapes(content), m.empties(content)
    else:
        shapes, empties = spark.createDataFrame([], "shape string, n long"), m.count
    got = matches(shapes, templates(spark, classes)).persist()
    hit = {r[0] for r in got.select("place").distinct().collect()}
    unmatched = []
    blank = 0
    for i, c in enumerate(classes):
        t = c.get("template")
        if t is not None and not str(t).strip():
            blank += 1
            if not empties:
                unmatched.append({"name": c.get("name"), "reason": "empty template but no record has empty content"})
        elif i not in hit:
            unmatched.append({"name": c.get("name"), "reason": "no template" if t is None else "matches no observed shape"})
    own = owners(got)
    covered = (own.agg(F.sum("n")).first()[0] or 0) + blank * empties
    none = shapes.filter("shape is null").agg(F.sum("n")).first()[0] or 0
    rest = residue(shapes, own)
    n, single = rest.agg(F.count("*"), F.count_if(F.col("n") == 1)).first()
    top = [{"shape": r.shape, "records": r.n} for r in rest.orderBy(F.desc("n"), "shape").limit(8).collect()]
    total = m.count - none
    share = covered / total if total else 0.0
    sizes = {r.place: r for r in got.groupBy("place").agg(F.count("*").alias("shapes"), F.sum("n").alias("records")).collect()}
    shown: dict = {}
    for r in absorbed(got).filter(F.col("rank") <= SHOWN_SHAPES).orderBy("place", "rank").collect():
        shown.setdefault(r.place, []).append(r["shape"])
    matched = [{"name": classes[k].get("name"), "template": classes[k].get("template"), "shapes": r.shapes, "records": r.records, "shortest_shapes": shown[k]} for k, r in sorted(sizes.items())]
    got.unpersist()
    yield Result("classes_resolve", not unmatched, f"{len(unmatched)} of {len(classes)} classes match nothing" if unmatched else f"all {len(classes)} classes match a shape", {"unmatched": unmatched, "matched": matched})
    yield Result("every_record_classed", share >= COVERAGE, f"{share:.1%} of templatable records are in a class (threshold {COVERAGE:.0%})", {"coverage": round(share, 4), "residue_records": total - covered, "residue_shapes": n, "residue_shapes_seen_once": single, "residue_top_shapes": top, "untemplatable_records": none})


def _clock(schema: dict, m: Measurement, hint: str | None) -> Result:
    clocks, declared = m.clocks, schema.get("time_field") or hint
    if not clocks:
        return Result("clock_resolvable", False, "no field in the data parses as a timestamp", {}, True)
    best = clocks[0]
    if declared and declared != best["field"]:
        return Result("clock_resolvable", False, f"the schema declares {declared!r} but the best clock is {best['field']!r}", {"ranked": clocks[:4]})
    ok = best["parse_rate"] >= 0.99 and best["monotonic"] >= 0.95
    return Result("clock_resolvable", ok, f"{best['field']} parses {best['parse_rate']:.0%} and is monotonic {best['monotonic']:.0%}", best)


def build_classifier(schema: dict, records: DataFrame) -> tuple[DataFrame, dict]:
    """records with `class` by the longest template, and how many it covers; shapes not in records have no class."""
    from .shapes import classify

    spark, content = records.sparkSession, content_field(schema)
    classes = declared_classes(schema)
    empty = next((c.get("name") for c in classes if not str(c.get("template") or "").strip()), None)
    shapes = shape_counts(records, content)
    own = owners(matches(shapes, templates(spark, classes)), "longest").persist()
    out = classify(records, content, own, empty)
    a = out.agg(F.count("*").alias("seen"), F.count("class").alias("classified")).first()
    return out, {"shapes": shapes.filter("shape is not null").count(), "claimed": own.select("name").distinct().count(), "seen": a.seen, "classified": a.classified, "unclassified": a.seen - a.classified, "empty_class": empty}
