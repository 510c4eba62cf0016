"""Event shapes and the classes that own them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import non_empty, skeleton

# Words that stand for a variable in a template.
PLACEHOLDER_WORDS = frozenset(
    "HOST IP ADDR ADDRESS PORT N NUM PID PROC QUEUE_ID QID Q HEX HASH ID EMAIL MAILBOX RCPT DOMAIN REASON STATUS CODE DSN SERVICE DAEMON TEXT MSG SIZE DELAY RELAY NRCPT KEY TIME TS PROTO CIPHER VERSION USER NAME PATH FILE COUNT SECS SECONDS MINS MINUTES DAYS RETRY ATTEMPT SEQ X Y".split()
)
RULES = ("specific", "longest", "declared")
_EDGE = ":,;()[]{}."


def shape_counts(records: DataFrame, content: str) -> DataFrame:
    """shapes(shape, n): distinct skeletons of non-empty content; the null shape counts what is no template."""
    c = F.col(f"`{content}`").cast("string")
    return records.filter(non_empty(c)).groupBy(skeleton(c).alias("shape")).agg(F.count("*").alias("n"))


_TOKEN = re.compile(r"<[^>]*>|[^\s<]+|<")


def literal_words(template: str) -> list[str]:
    """The words a template pins down, its variables left out.

    Of key=value both sides are words as they are; other words count without
    the punctuation around them, from two characters on, unless they stand for
    a variable.
    """
    text = _TOKEN.sub(lambda m: " " if m[0].endswith(">") and m[0].startswith("<") else m[0], template)
    out: list[str] = []
    for bare in (token.strip(_EDGE) for token in text.split()):
        key, sign, value = bare.partition("=")
        if sign:
            out.extend(w for w in (x.strip(":,;()") for x in (key, *value.split("="))) if w)
        elif len(bare) > 1 and bare.upper() not in PLACEHOLDER_WORDS:
            out.append(bare)
    return out


def wanted_words(template: str) -> list[str]:
    """literal_words, or a single character that is a code; nothing matches an empty list."""
    words, bare = literal_words(template), template.strip().strip(_EDGE).strip()
    return words or ([bare] if len(bare) == 1 and bare.upper() not in PLACEHOLDER_WORDS else [])


def containment(template: str) -> str | None:
    """A pattern for ' shape ' that has the template's words in order."""
    words = wanted_words(template)
    return " " + " (?:.* )?".join(re.escape(w).replace("\\ ", " ") for w in words) + " " if words else None


def templates(spark, classes: list[dict]) -> DataFrame:
    """classes(place, name, template, pattern, specificity, raw_words) of a schema's classes; one small row each."""
    rows = [(i, c.get("name"), c.get("template"), containment(c["template"]) if (c.get("template") or "").strip() else None, len(literal_words(c.get("template") or "")), len((c.get("template") or "").split())) for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, "place int, name string, template string, pattern string, specificity int, raw_words int")


def matches(shapes: DataFrame, classes: DataFrame) -> DataFrame:
    """Every class with every shape that contains its words in order; shapes are aggregated, classes are few and broadcast."""
    s = shapes.filter("shape is not null")
    return s.join(F.broadcast(classes.filter("pattern is not null")), F.expr("rlike(concat(' ', shape, ' '), pattern)"))


def owners(matched: DataFrame, rule: str = "specific") -> DataFrame:
    """owner(shape, n, name): one class for each matched shape.

    specific: most literal words; longest: most words of the template as
    written; declared: the first declared. Ties go to the first declared.
    """
    order = {"specific": [F.desc("specificity"), "place"], "longest": [F.desc("raw_words"), "place"], "declared": ["place"]}[rule]
    w = Window.partitionBy("shape").orderBy(*order)
    return matched.withColumn("at", F.row_number().over(w)).filter("at = 1").select("shape", "n", "name", "template")


def absorbed(matched: DataFrame) -> DataFrame:
    """name, rank, shape, n: every shape that a class's words occur in, shortest first, then by text."""
    order = Window.partitionBy("place").orderBy(F.length("shape"), "shape")
    return matched.select("place", "name", F.row_number().over(order).alias("rank"), "shape", "n")


def residue(shapes: DataFrame, owner: DataFrame) -> DataFrame:
    """Shapes that no class owns."""
    return shapes.filter("shape is not null").join(owner.select("shape"), "shape", "left_anti")


def classify(records: DataFrame, content: str, owner: DataFrame, empty_class: str | None = None) -> DataFrame:
    """records with shape and class: by the owner of the shape, or the empty class where content is empty."""
    c = F.col(f"`{content}`").cast("string")
    r = records.withColumn("shape", F.when(non_empty(c), skeleton(c)))
    # shapes may be as many as records in free text, so the join is left to their size
    r = r.join(owner.select(F.col("shape").alias("of"), F.col("name").alias("class")), F.col("shape") == F.col("of"), "left").drop("of")
    return r.withColumn("class", F.when(~F.coalesce(non_empty(c), F.lit(False)), F.lit(empty_class)).otherwise(F.col("class")))
