"""Connected components over an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``: long); ``root`` is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label (pointer jumping), so long chains halve.
    Aggregation is partial before the shuffle, so a hub with very many
    neighbours arrives as one row per task.  Every round is written to the
    shared folder; the round before last is removed.  Raises when
    ``max_rounds`` don't suffice rather than return a partial answer.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").where("a <> b")
    path = new_path(spark, "cc-edges")
    both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(path)
    both = spark.read.parquet(path)
    prev_path = new_path(spark, "cc-labels")
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")).write.parquet(prev_path)
    for _ in range(max_rounds):
        labels = spark.read.parquet(prev_path)
        seen = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "root")
        best = labels.unionByName(seen).groupBy("node").agg(F.min("root").alias("root"))
        up = best.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = best.join(up, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"))
        path = new_path(spark, "cc-labels")
        jumped.write.parquet(path)
        now = spark.read.parquet(path)
        moved = now.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        old, prev_path = prev_path, path
        drop_path(spark, old)
        if not moved:
            return spark.read.parquet(prev_path)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
