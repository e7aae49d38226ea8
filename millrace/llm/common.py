"""Helpers shared by the training-data operators: shared-folder tables, Arrow batches, word splitting."""

from __future__ import annotations

import atexit
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words, lower-cased A-Z first: one byte table does both.
#: UTF-8 bytes over 0x7F are never separators, so the table is right for every script.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: A-Z to a-z only; ``bytes.split()`` then cuts at 0x20 and 0x09-0x0D exactly.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Spark's setting that removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: list[tuple[SparkSession, str]] = []
_PATHS: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local default only where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "/tmp/millrace-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_table(df: DataFrame, tag: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, never a recomputation. The shuffle files of the
    writing go as soon as it ends; the folder is removed by ``drop_tables`` or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _TABLES.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Remove the folders of shared tables that nothing reads any more."""
    for df in tables:
        ref, path = _PATHS.pop(id(df), (lambda: None, ""))
        if ref() is df:
            _remove(df.sparkSession, path)
            _TABLES.remove((df.sparkSession, path))


@atexit.register
def _remove_all() -> None:
    for spark, path in _TABLES:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already: then nothing is left to do
        pass


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes (null stays None)."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])
