"""Tables, their keys, and what is known about them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.types import PlanError, type_name


@dataclass
class Table:
    name: str
    df: DataFrame  # columns under their upper-case names
    primary_key: str | None = None
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, column)
    rows: int | None = None  # set by analyze()
    path: str | None = None  # folder, if persisted


class Catalog:
    """All tables of a session. Names are upper case; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.pending: dict[str, tuple[Callable[[], DataFrame], str | None]] = {}

    def register_later(self, name: str, load: Callable[[], DataFrame], primary_key: str | None = None) -> None:
        """A table whose file is only opened when a plan names it; the key is taken as given."""
        self.pending[name.upper()] = (load, primary_key)

    def open(self, *names: str) -> None:
        """Open pending tables: the named ones, or all."""
        for n in names or list(self.pending):
            if n.upper() in self.pending:
                load, key = self.pending.pop(n.upper())
                self.register(n, load()).primary_key = key

    def register(self, name: str, df: DataFrame, replace: bool = False) -> Table:
        name = name.upper()
        if (name in self.tables or name in self.pending) and not replace:
            raise PlanError(f"table {name} exists already")
        # timestamps are dates here; the cast keeps the scan's other columns pushed down
        cols = [F.to_date(F.col(f"`{c}`")).alias(c.upper()) if t.startswith("timestamp") else F.col(f"`{c}`").alias(c.upper()) for c, t in df.dtypes]
        self.tables[name] = Table(name, df.select(*cols))
        return self.tables[name]

    def table(self, name: str) -> Table:
        self.open(name)
        if name.upper() not in self.tables:
            system = self.system_table(name.upper())
            if system is None:
                raise PlanError(f"no table {name}")
            return Table(name.upper(), system)
        return self.tables[name.upper()]

    def owners(self, column: str) -> list[str]:
        """Tables with that column."""
        self.open()
        return [n for n, t in self.tables.items() if column.upper() in t.df.columns]

    def drop(self, name: str) -> None:
        self.open(name)
        t = self.tables.pop(name.upper(), None)
        if t is None:
            raise PlanError(f"no table {name}")
        if t.path:
            _delete(self.spark, t.path)

    def rename(self, old: str, new: str) -> bool:
        """False if ``old`` is missing or ``new`` is taken."""
        old, new = old.upper(), new.upper()
        self.open(old, new)
        if old not in self.tables or new in self.tables:
            return False
        t = self.tables.pop(old)
        t.name = new
        self.tables[new] = t
        for other in self.tables.values():
            other.foreign_keys = {c: (new if r[0] == old else r[0], r[1]) for c, r in other.foreign_keys.items()}
        return True

    def insert(self, name: str, values: tuple) -> None:
        t = self.table(name)
        fields = t.df.schema.fields
        if len(values) != len(fields):
            raise PlanError(f"{len(values)} values for {len(fields)} columns of {name}")
        if any(v is None for v in values):
            raise PlanError("NULL can't be inserted")
        row = self.spark.range(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields, strict=True)])
        t.df, t.rows = t.df.unionByName(row), None

    def add_primary_key(self, table: str, column: str, check: bool = True) -> None:
        t, column = self.table(table), column.upper()
        self._known(t, column)
        if check and not t.df.groupBy(column).count().where("count > 1").isEmpty():
            raise PlanError(f"{table}.{column} is not unique")
        t.primary_key = column

    def add_foreign_key(self, table: str, column: str, parent: str, parent_column: str) -> None:
        t, p = self.table(table), self.table(parent)
        self._known(t, column.upper())
        if p.primary_key != parent_column.upper():
            raise PlanError(f"{parent}.{parent_column} is not a primary key")
        t.foreign_keys[column.upper()] = (p.name, parent_column.upper())

    @staticmethod
    def _known(t: Table, column: str) -> None:
        if column not in t.df.columns:
            raise PlanError(f"no column {column} in {t.name}")

    def analyze(self, name: str) -> DataFrame:
        """Count, minimum, maximum, mean and deviation per numeric column, in one pass; remembers the row count."""
        t = self.table(name)
        numeric = [c for c, k in t.df.dtypes if k in ("int", "bigint", "float", "double", "smallint")]
        aggs = [F.count(F.lit(1)).alias("rows")] + [F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("avg"), F.stddev(c).alias("stddev"), F.approx_count_distinct(c).alias("distinct")).alias(c) for c in numeric]
        row = t.df.agg(*aggs).first()
        t.rows = row["rows"]
        rows = [(name.upper(), c, t.rows, *row[c]) for c in numeric]
        return self.spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, ROW_COUNT long, MIN double, MAX double, AVG double, STDDEV double, DISTINCT_COUNT long")

    def histogram(self, table: str, column: str, buckets: int = 100) -> list[float]:
        """Bounds of an equi-height histogram."""
        shares = [k / buckets for k in range(buckets + 1)]
        return self.table(table).df.agg(F.percentile_approx(column.upper(), shares, 10_000)).first()[0]

    def system_table(self, name: str) -> DataFrame | None:
        if name.startswith("SYS_"):
            self.open()
        if name == "SYS_DATABASE_SCHEMA":
            rows = [(t.name, c, type_name(f.dataType)) for t in self.tables.values() for c, f in zip(t.df.columns, t.df.schema.fields, strict=True)]
            return self.spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, ATTRIBUTE_TYPE string")
        if name == "SYS_INTEGRITY_CONSTRAINTS":
            rows = [(t.name, t.primary_key, "PRIMARY KEY", None, None) for t in self.tables.values() if t.primary_key]
            rows += [(t.name, c, "FOREIGN KEY", p, k) for t in self.tables.values() for c, (p, k) in t.foreign_keys.items()]
            return self.spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, KIND string, PARENT_TABLE string, PARENT_COLUMN string")
        return None

    # persistence: a Parquet folder per table and one JSON line of constraints beside it

    def save(self, name: str, folder: str) -> None:
        t = self.table(name)
        path = f"{folder.rstrip('/')}/{t.name}"
        t.df.write.mode("error").parquet(f"{path}/data")
        meta = json.dumps({"primary_key": t.primary_key, "foreign_keys": t.foreign_keys})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/constraints")
        t.path, t.df = path, self.spark.read.parquet(f"{path}/data")

    def load_database(self, folder: str) -> list[str]:
        """Register every table that was saved below ``folder``."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "constraints")))
        for n in names:
            t = self.register(n, self.spark.read.parquet(f"{folder.rstrip('/')}/{n}/data"), replace=True)
            meta = json.loads(self.spark.read.text(f"{folder.rstrip('/')}/{n}/constraints").first()[0])
            t.path, t.primary_key = f"{folder.rstrip('/')}/{n}", meta["primary_key"]
            t.foreign_keys = {c: tuple(p) for c, p in meta["foreign_keys"].items()}
        return names

    def unload(self) -> None:
        self.tables.clear()
        self.pending.clear()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
