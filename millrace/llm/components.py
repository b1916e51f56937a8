"""Connected components of a link table, by repeated hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.shared import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint, not NULL; in any direction, repeats and loops allowed); root
    is one node of the component, the same for all of it.

    Each round at least halves the nodes that have links left, and its tables are written, so that a lost executor costs
    a reread. Hubs are pre-aggregated before the shuffle; in joins Spark splits their partitions.
    """
    edges = settle(links.select("a", "b").where("a <> b"), "edges")
    whole = None
    while edges.take(1):
        ends = edges.union(edges.select("b", "a"))
        hooked = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"))
        hooked = settle(hooked, "hooked")
        for _ in range(2):
            up = hooked.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            hooked = settle(hooked.join(up, "p").select("node", F.col("pp").alias("p")), "jumped")
        if whole is None:
            whole = hooked.select("node", F.col("p").alias("root"))
        else:
            up = hooked.select(F.col("node").alias("root"), "p")
            whole = settle(whole.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        left = edges.join(hooked.select(F.col("node").alias("a"), F.col("p").alias("x")), "a")
        left = left.join(hooked.select(F.col("node").alias("b"), F.col("p").alias("y")), "b").where("x <> y")
        edges = settle(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if whole is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole
