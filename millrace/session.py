"""The engine's front door: SQL, JSON plans, plan objects and scripts over one catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog import Catalog
from millrace.plans import jsonplan, sql
from millrace.plans.lower import Engine
from millrace.plans.nodes import Node

#: Tables of the standard data set, with their keys.
STANDARD = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
PRIMARY = {"REGION": "R_REGIONKEY", "NATION": "N_NATIONKEY", "CUSTOMER": "C_CUSTKEY", "SUPPLIER": "S_SUPPKEY", "PART": "P_PARTKEY", "ORDERS": "O_ORDERKEY"}


class Session:
    def __init__(self, spark: SparkSession):
        self.catalog = Catalog(spark)
        self.engine = Engine(self.catalog)

    @classmethod
    def over(cls, spark: SparkSession, folder: str, tables: tuple[str, ...] = STANDARD) -> Session:
        """A session over a folder of ``<table>.parquet``; its keys are taken as given, not checked."""
        s = cls(spark)
        for t in tables:
            s.catalog.register_later(t, lambda t=t: spark.read.parquet(f"{folder}/{t}.parquet"), PRIMARY.get(t.upper()))
        return s

    def run(self, plan: Node) -> DataFrame:
        return self.engine.execute(plan)

    def sql(self, text: str) -> DataFrame:
        return self.run(sql.parse(text))

    def json(self, text: str) -> DataFrame:
        return self.run(jsonplan.load(text))
