"""Records as normalised events, and the ids of messages they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import canonical_name, clock_micros, field_state, is_placeholder, message_ids, non_empty, skeleton
from ..schema import content_field, declared_classes, declared_fields, identity_key
from .cells import columns_of
from .shapes import containment


def message_id_stats(records: DataFrame, field: str, pattern: str) -> DataFrame:
    """records, records_with_id, distinct_ids, records_with_several of a message pattern."""
    r = records.select(message_ids(F.col(f"`{field}`").cast("string"), pattern).alias("ids"))
    a = r.agg(F.count("*").alias("records"), F.count_if(F.size("ids") > 0).alias("records_with_id"), F.count_if(F.size("ids") > 1).alias("records_with_several"))
    return a.crossJoin(F.broadcast(r.select(F.explode("ids").alias("id")).agg(F.countDistinct("id").alias("distinct_ids"))))


def message_lifecycles(records: DataFrame, field: str, pattern: str, clock) -> DataFrame:
    """Extension: id, n, first, last of every message id, across records and programs."""
    x = records.select(clock.alias("t"), F.explode(message_ids(F.col(f"`{field}`").cast("string"), pattern)).alias("id"))
    return x.groupBy("id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def project(schema: dict, records: DataFrame, pos: str = "pos") -> DataFrame:
    """One event per record: identity, wall time, message ids, class, stream, content, field states and notes.

    Records are classified by the first declared class that matches their
    shape; redacted values never leave field_state's placeholder.
    """
    names = columns_of(records, pos)
    text = {n: F.col(f"`{n}`").cast("string") for n in names}
    missing = F.lit(None).cast("string")
    col = lambda p: text.get(p.split(".")[0], missing)
    content, key = content_field(schema), (identity_key(schema) or "").split("+")
    key = [k for k in key if k]
    r = records
    if content and content in text:
        # A record's class is a function of its shape: no join, whose task for a frequent shape would hold its records
        named = missing
        for c in reversed(declared_classes(schema)):
            pattern = containment(c["template"]) if (c.get("template") or "").strip() else None
            if pattern:
                named = F.when(F.concat(F.lit(" "), F.col("shape"), F.lit(" ")).rlike(pattern), F.lit(c.get("name")).cast("string")).otherwise(named)
        r = records.withColumn("shape", F.when(non_empty(text[content]), skeleton(text[content]))).withColumn("class", named)
        share = records.filter(non_empty(text[content])).agg(F.coalesce(F.avg(is_placeholder(text[content]).cast("double")), F.lit(0.0)).alias("redaction_share"))
        r = r.crossJoin(F.broadcast(share))
    else:
        r = r.withColumns({"class": missing, "shape": missing, "redaction_share": F.lit(0.0)})
    parts = [col(k) for k in key]
    paths = [f["path"] for f in declared_fields(schema)] or names
    clock = schema.get("time_field")
    if clock:
        wall = clock_micros(col(clock))
        precision = F.when(wall.isNotNull(), "exact").otherwise("unresolved")
    else:
        wall = F.coalesce(*[clock_micros(col(p)) for p in paths])
        precision = F.when(wall.isNotNull(), "inferred").otherwise("unresolved")
    mk = schema.get("message_key") or {}
    ids = message_ids(col(mk["field"]), mk["pattern"]) if mk.get("field") and mk.get("pattern") else F.array().cast("array<string>")
    stream = schema.get("stream")
    stream = col(stream["field"]) if isinstance(stream, dict) and stream.get("field") else F.lit(stream if isinstance(stream, str) else None).cast("string")
    hidden = F.lit(False)
    for p in parts:
        hidden = hidden | F.coalesce(is_placeholder(p), F.lit(False))
    body = col(content) if content else missing
    shown = schema.get("content_field")
    body = col(shown) if shown else body
    notes = F.array(
        F.when(hidden, "identity has a redacted component"),
        F.when(F.coalesce(is_placeholder(body), F.lit(False)), "content is partly redacted; its shape survives"),
        F.when(F.lit(not clock), "no declared clock; time is a fallback"),
        F.when(F.col("class").isNull(), "no declared class matches"),
    )
    return r.select(
        F.col(pos).alias("index"),
        F.struct(F.date_format(F.timestamp_micros(wall), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), precision.alias("precision")).alias("wall"),
        F.struct(F.array(*[F.struct(F.lit(k).alias("field"), field_state(p).alias("state")) for k, p in zip(key, parts)]).alias("fields") if key else F.lit(None).cast("string").alias("fields"), F.lit(schema.get("identity_kind") or "+".join(key) or None).alias("kind"), (canonical_name(parts) if parts else missing).alias("canonical_name")).alias("identity"),
        F.struct(F.lit(mk.get("name")).cast("string").alias("name"), ids.alias("ids")).alias("message"),
        F.struct(F.col("class").alias("name"), F.col("shape").alias("template")).alias("class"),
        stream.alias("stream_hint"),
        F.struct(F.lit(shown or content).cast("string").alias("field"), body.alias("body_text"), F.col("redaction_share")).alias("content"),
        F.array(*[F.struct(F.lit(p).alias("path"), field_state(col(p)).alias("state")) for p in paths]).alias("fields"),
        F.filter(notes, lambda n: n.isNotNull()).alias("notes"),
    )


def preview_summary(events: DataFrame) -> dict:
    """Counts over the shown events."""
    a = events.agg(F.count("*").alias("shown"), F.countDistinct("identity.canonical_name").alias("identities"), F.count_if(F.col("content.redaction_share") > 0.5).alias("redacted"), F.count_if(F.col("wall.precision") == "unresolved").alias("unresolved")).first().asDict()
    a["classes"] = {r[0]: r[1] for r in events.groupBy("class.name").count().collect()}
    return a
