"""Connected components of a link table, by label propagation with pointer jumping in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shared_table


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of ``links`` (a, b: any order, repeats allowed).

    Each round takes the least label among a node's neighbours (aggregated before the shuffle), hooks the
    old label's node to it as well, and jumps to the label's own label; rounds grow with the logarithm of
    a component's diameter in practice. Nothing but a count of changes comes to the driver.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = shared_table(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared_table(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        met = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new"))
        hooked = met.groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        first = met.join(hooked, "node", "left").select("node", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        jump = first.select(F.col("node").alias("new"), F.col("new").alias("further"))
        after = shared_table(first.join(jump, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), (F.least("new", F.coalesce("further", "new")) < F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels
