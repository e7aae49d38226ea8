"""k-means as repeated plans: cross join with the (k-row) centroids, nearest one per point, new means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(points: DataFrame, centroids: list[tuple[float, ...]], dims: list[str]) -> DataFrame:
    """``points`` with CID, the nearest centroid's number (the lower one if tied). k centroids are constants of the plan,
    so no join is needed."""
    distance = lambda c: F.sqrt(sum((F.pow(F.col(d) - F.lit(float(v)), F.lit(2)) for d, v in zip(dims, c, strict=True)), F.lit(0.0)))
    nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(k).cast("long").alias("CID")) for k, c in enumerate(centroids)]))
    return points.withColumn("CID", nearest["CID"])


def kmeans(points: DataFrame, centroids: list[tuple[float, ...]], dims: list[str], rounds: int = 20, tolerance: float = 0.05) -> list[tuple[float, ...]]:
    """Centroids after ``rounds`` or when they move by no more than ``tolerance`` in sum; only k rows leave the cluster a round."""
    for _ in range(rounds):
        means = {r["CID"]: tuple(r[d] for d in dims) for r in assign(points, centroids, dims).groupBy("CID").agg(*[F.avg(d).alias(d) for d in dims]).collect()}
        new = [means.get(k, c) for k, c in enumerate(centroids)]
        moved = sum(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 for a, b in zip(new, centroids, strict=True))
        centroids = new
        if moved <= tolerance:
            break
    return centroids
