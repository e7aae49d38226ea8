"""Plans over file streams: a streaming DataFrame registered as a table runs through the same lowering."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.catalog import Catalog
from millrace.plans import nodes as N
from millrace.plans.lower import Engine


def stream_table(catalog: Catalog, name: str, path: str, schema: T.StructType, files_per_trigger: int = 100) -> None:
    """Register the Parquet files that arrive in ``path`` as table ``name``."""
    catalog.register(name, catalog.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def start(engine: Engine, plan: N.Node, query: str, mode: str = "complete") -> StreamingQuery:
    """Run a plan over streaming tables into an in-memory table ``query``, over what there is now."""
    return engine.execute(plan).writeStream.format("memory").queryName(query).outputMode(mode).trigger(availableNow=True).start()
