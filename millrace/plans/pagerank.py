"""PageRank over an edge table: joins and keyed sums, iterated by the driver with settled intermediate ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.shared import settle


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(node, rank) for the nodes of ``edges`` (src, dst; parallel edges count).

    rank' = (1 - d) / n + d * (dangling / n + received). Stops when the mean absolute change of an iteration is under
    ``tolerance`` (0: never). Edges are dealt by source once (a hot source over all tasks) and stay so, on disk where memory is short: an iteration
    shuffles ranks and sums of rank mass, taken on the map side, so that a node with many in-links costs a task one row.
    Ranks are settled in every iteration.
    """
    edges = edges.select("src", "dst")
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(edges.select("dst", F.lit(0)))
    nodes = settle(ends.groupBy("node").agg(F.sum("out").alias("degree")), "nodes")
    n, total = nodes.agg(F.count(F.lit(1)), F.sum("degree")).first()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # sources with more edges than a task's even share, so fewer than tasks, are dealt by target too
    hot = nodes.where(F.col("degree") > total / parts).select(F.col("node").alias("src"), F.lit(parts).alias("salts"))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("dst"), F.col("salts"))).otherwise(0).cast("int")
    dealt = edges.join(F.broadcast(hot), "src", "left").select("src", "dst", salt.alias("salt")).repartition(parts, "src", "salt").persist()
    salts = F.when(F.col("degree") > total / parts, F.lit(parts)).otherwise(1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    try:
        for _ in range(iterations):
            share = ranks.where("degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
            none = F.lit(None)
            given = dealt.join(share, ["src", "salt"]).select(F.col("dst").alias("node"), "share", none.cast("bigint").alias("degree"), none.cast("double").alias("old"))
            # one sum gives every node what it received and its own row
            own = ranks.select("node", F.lit(0.0).alias("share"), "degree", F.col("rank").alias("old"))
            met = given.union(own).groupBy("node").agg(F.sum("share").alias("received"), F.max("degree").alias("degree"), F.max("old").alias("old"))
            dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling"))
            renewed = F.lit((1 - damping) / n) + F.lit(damping) * (F.col("dangling") / n + F.col("received"))
            ranks = settle(met.crossJoin(F.broadcast(dangling)).select("node", "degree", "old", renewed.alias("rank")), "ranks")  # one row
            if tolerance and ranks.agg(F.avg(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                break
    finally:
        dealt.unpersist()
    return ranks.select("node", "rank")
