"""Field types of a series, their storage sizes, defaults and compatibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldType:
    """One storable type: the tall table's value column for it and the bytes of an entry (8 of them are ticks)."""

    name: str
    spark: T.DataType
    entry_bytes: int
    default: float | int | str

    @property
    def column(self) -> str:
        return f"v_{self.name}"


FIELD_TYPES = {
    t.name: t
    for t in (
        FieldType("float", T.FloatType(), 12, float("nan")),
        FieldType("double", T.DoubleType(), 16, float("nan")),
        FieldType("int", T.IntegerType(), 12, 0),
        FieldType("long", T.LongType(), 16, 0),
        FieldType("string", T.StringType(), 256, ""),
    )
}
VALUE_COLUMNS = [t.column for t in FIELD_TYPES.values()]
#: Bytes of text that a string entry holds: 256 less ticks, length and end mark.
STRING_BYTES = 246


def field_type(dtype: T.DataType | str) -> FieldType:
    """The field type that stores a Spark type; others are rejected."""
    for t in FIELD_TYPES.values():
        if dtype in (t.spark, t.name, t.spark.simpleString()):
            return t
    raise TypeError(f"{dtype} cannot be stored in a series")


def fungible(written: str, stored: str) -> bool:
    """Whether a value of one type may go into a column of another: only if they are equal, nothing is widened."""
    return field_type(written) is field_type(stored)


def type_matrix(spark: SparkSession) -> DataFrame:
    """``written, stored, fungible, entry_bytes`` for every pair of types."""
    rows = [(a, b, fungible(a, b), FIELD_TYPES[b].entry_bytes) for a in FIELD_TYPES for b in FIELD_TYPES]
    return spark.createDataFrame(rows, "written string, stored string, fungible boolean, entry_bytes long")


def with_default(value: Column, kind: str) -> Column:
    """A value, or its type's default before the first observation."""
    t = field_type(kind)
    return F.coalesce(value, F.lit(t.default).cast(t.spark))


def typed_field(df: DataFrame, name: str, kind: str) -> Column:
    """The column ``name`` as ``kind``; null where the column is unknown or of another type, as nothing is converted."""
    t = field_type(kind)
    known = name in df.columns and df.schema[name].dataType == t.spark
    return (F.col(f"`{name}`") if known else F.lit(None).cast(t.spark)).alias(name)


def entries_equal(a: Column, b: Column) -> Column:
    """Null-safe equality of entries, in which NaN equals NaN."""
    return a.eqNullSafe(b)


def truncated(text: Column, latin: bool = False) -> Column:
    """A string as an entry holds it: 246 characters at most, in strict mode the low byte of each."""
    cut = F.substring(text, 1, STRING_BYTES)
    if not latin:
        return cut
    low = F.transform(F.filter(F.split(cut, ""), lambda c: c != ""), lambda c: F.char(F.ascii(c) % 256))
    return F.array_join(low, "")
