"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternates the large-star and small-star operations (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): the number of edges never grows beyond the input's order, and rounds follow the
    logarithm of the longest path. Every round's edges are written to the shared folder, so lineage
    stays short and no executor's loss costs more than a round. Null ends and loops are ignored. The result
    is kept in ``scratch`` if that is given, else until the Python process ends.
    """
    spark = edges.sparkSession
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b").select(least.alias("a"), most.alias("b")).distinct()
    with Scratch(spark) as own:
        now, before = own.keep(now, "edges"), None
        for _ in range(max_rounds):
            # large star: larger neighbours go to the least neighbour (itself included)
            both = now.union(now.select("b", "a"))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
            # small star: smaller neighbours and itself go to the least neighbour
            low = large.groupBy("b").agg(F.min("a").alias("m"))
            small = large.join(low, "b").select("m", "a").filter("m <> a").union(low.select("m", "b")).toDF("a", "b").distinct()
            # how many edges there are and which, told by the write itself: equal to the round before when nothing moves any more
            seen = Observation()
            now = own.keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
            sign = tuple(seen.get.values())
            if sign == before:
                break
            before = sign
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        labels = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        found = labels.union(roots)
        return scratch.keep(found, "components") if scratch else own.result(found, "components")
