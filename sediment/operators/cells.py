"""Records in long form: one row for each key of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalars import trimmed
from ..sources.jsonrecords import TYPES


def tag_of(c, kind: T.DataType):
    """The type tag of a value, from its Spark type."""
    if isinstance(kind, T.BooleanType):
        tag = F.lit("bool")
    elif isinstance(kind, T.IntegralType):
        tag = F.lit("int")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        tag = F.lit("float")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        tag = F.lit("structured")
    else:
        tag = F.when(trimmed(c.cast("string")) == "", "empty-string").otherwise("str")
    return F.when(c.isNull(), "null").otherwise(tag)


def text_of(c, kind: T.DataType):
    """The text form of a value: Spark's cast, JSON for nested values."""
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def columns_of(df: DataFrame, pos: str) -> list[str]:
    """The fields of a table of records."""
    return [c for c in df.columns if c not in (pos, TYPES)]


def cells(df: DataFrame, pos: str, fields: list[str] | None = None) -> DataFrame:
    """cells(pos, field, vtype, sval) of a table; pos is a column that orders its rows.

    Where a reader gives each record's own keys and their types (TYPES), only
    these give rows; else every column does, with the type of the column.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = fields or (columns_of(df, pos) if TYPES in kinds else list(kinds))

    def cell(n: str):
        c = F.col(f"`{n}`")
        if TYPES not in kinds:
            return F.struct(F.lit(n).alias("field"), tag_of(c, kinds[n]).alias("vtype"), text_of(c, kinds[n]).alias("sval"))
        own = F.element_at(F.col(f"`{TYPES}`"), n)
        return F.when(own.isNotNull(), F.struct(F.lit(n).alias("field"), own.alias("vtype"), c.alias("sval")))

    if not fields:
        return df.sparkSession.createDataFrame([], "pos long, field string, vtype string, sval string")
    one = F.filter(F.array(*[cell(n) for n in fields]), lambda x: x.isNotNull())
    return df.select(F.col(pos).cast("long").alias("pos"), F.explode(one).alias("c")).select("pos", "c.*")
