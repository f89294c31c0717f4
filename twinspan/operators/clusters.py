"""Connected components of location graphs, and what is summed up per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.skew import in_order, lookup
from twinspan.work import Workspace


def components(edges: DataFrame, a: str, b: str, work: Workspace) -> DataFrame:
    """(id, component): the least id reachable, for every id of an edge, by alternating large and small stars.

    A large star joins every larger neighbour of a vertex to its least neighbour, a small star every smaller one; both keep
    connectivity, and the number of rounds is logarithmic in practice. Each round is a written table.
    """
    lo, hi = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    now = work.write(edges.where((F.col(a) != F.col(b))).select(hi, lo).distinct().select(F.col("v").alias("u"), F.col("u").alias("v")), "edges")  # u > v
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each vertex with its larger neighbours
        large = lookup(up, least.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.write(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        after = work.write(small.distinct(), "edges")
        work.drop(now, large)
        now = after
        # done when every vertex has one edge, to a vertex that has none
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def numbered(members: DataFrame, component: str, key: str, work: Workspace) -> DataFrame:
    """(key, cluster): clusters numbered from 0 by their least key, for a snapshot's summary.

    Each component has one least key, so the numbers come from a sort of the components alone, not of the members.
    """
    rows = work.write(members.select(component, key), "members")
    ranked = in_order(rows.groupBy(component).agg(F.min(key).alias("_first")), "_first", "cluster", work)
    return lookup(rows, ranked.select(component, "cluster"), component).select(key, "cluster")
