"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.plans.lineage import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """cls, component: for links(a, b), the least node each node is connected with.

    Alternates large-star and small-star rounds, whose number grows with the
    logarithm of the longest path. Each round is two group-bys whose state per
    node is one minimum; its result is checkpointed.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = cut(small)
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "cls")
    roots = edges.select(F.col("v").alias("cls"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
