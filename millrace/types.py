"""Attribute types of the engine and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Type names accepted by CREATE TABLE, JSON plans and self-describing CSV.
SPARK_TYPES: dict[str, T.DataType] = {
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "SMALLINT": T.IntegerType(), "UINT32": T.LongType(), "OID": T.LongType(),
    "UNSIGNED INTEGER": T.LongType(), "UNSIGNED BIGINT": T.LongType(), "FLOAT": T.FloatType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(), "CHAR": T.StringType(), "CHARACTER": T.StringType(), "VARCHAR": T.StringType(), "DATE": T.DateType(), "BOOLEAN": T.BooleanType(),
}


class PlanError(ValueError):
    """A statement or plan the engine does not accept; the message says why."""


def spark_type(name: str) -> T.DataType:
    base = " ".join(name.upper().split("(")[0].split())
    if base not in SPARK_TYPES:
        raise PlanError(f"unsupported type {name}")
    return SPARK_TYPES[base]


def type_name(t: T.DataType) -> str:
    """The engine's name of a Spark type."""
    names = {T.IntegerType: "INT", T.ShortType: "INT", T.ByteType: "INT", T.LongType: "OID", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.DateType: "DATE", T.BooleanType: "BOOLEAN"}
    for kind, name in names.items():
        if isinstance(t, kind):
            return name
    raise PlanError(f"no attribute type for {t.simpleString()}")


def struct(columns: list[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type name) pairs."""
    return T.StructType([T.StructField(n, spark_type(t)) for n, t in columns])
