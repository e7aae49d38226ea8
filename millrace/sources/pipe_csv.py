"""Separator files: plain, and with a header line that describes the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.types import PlanError, struct, type_name

#: First token of a self-describing file's header.
HEADER = "#MILLRACE_TABLE"


def read_pipe_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = "|") -> DataFrame:
    """Lines starting with ``#`` and empty lines are skipped, fields trimmed; an empty text field is the empty string.

    There are no nulls in the data model: an empty or malformed field of another type is an error when it is read.
    """
    if separator != "|":
        raise PlanError("the field separator must be |")
    wide = T.StructType([*schema.fields, T.StructField("~end", T.StringType())])  # dbgen ends lines with a separator
    reader = spark.read.schema(wide).option("sep", separator).option("comment", "#").option("mode", "PERMISSIVE")
    df = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("dateFormat", "yyyy-M-d").csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        missing = F.lit("") if isinstance(f.dataType, T.StringType) else F.raise_error(F.lit(f"empty or malformed field {f.name}")).cast(f.dataType)
        cols.append(F.coalesce(c, missing).alias(f.name))
    return df.select(*cols)


def write_pipe_csv(df: DataFrame, path: str, separator: str = "|", header: bool = True) -> None:
    if separator != "|":
        raise PlanError("the field separator must be |")
    df.write.mode("overwrite").option("sep", separator).option("header", header).option("emptyValue", "").csv(path)


def write_self_describing(df: DataFrame, path: str) -> None:
    """One folder: ``schema`` holds the header line, ``data`` the rows. Nothing passes through one task."""
    line = "\t".join([HEADER, *(f"{c}:{type_name(f.dataType)}" for c, f in zip(df.columns, df.schema.fields, strict=True))])
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    write_pipe_csv(df, f"{path}/data", header=False)


def read_self_describing(spark: SparkSession, path: str) -> DataFrame:
    """Read such a folder, or a single file whose first line is the header."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(p)
    parts = spark.read.text(f"{path}/schema" if folder else path).first()[0].split("\t")
    if parts[0] != HEADER:
        raise PlanError(f"{path} has no {HEADER} header")
    return read_pipe_csv(spark, f"{path}/data" if folder else path, struct([tuple(x.rsplit(":", 1)) for x in parts[1:]]))
