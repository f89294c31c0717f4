"""Exact similarity joins of digest sets under rarity weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.functions.weights import reaches
from twinspan.operators.fingerprints import digest_counts, prefixes, totals, weighted_rows
from twinspan.work import Workspace


def weighted_sets(sets: DataFrame, key: str, work: Workspace, array: str = "digests", counted: DataFrame | None = None) -> DataFrame:
    """(key, digest, df, w) as a written table; counts are over ``counted``, or over the sets themselves."""
    counts = work.write(digest_counts(sets if counted is None else counted, array), "counts")
    return work.write(weighted_rows(sets, counts, key, array), "weighted")


def candidates(rows: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """(a, b), a < b: pairs that share a prefix digest and whose totals are near enough."""
    rare = prefixes(rows, key, num, den)
    left = rare.select("digest", F.col(key).alias("a"), F.col("total").alias("ta"))
    right = rare.select("digest", F.col(key).alias("b"), F.col("total").alias("tb"))
    near = F.least("ta", "tb") * den >= F.greatest("ta", "tb") * num
    return left.join(right, "digest").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def scored(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(a, b, shared_w, union_w) of pairs of sets: one pass with each side's set in an array, no join of digests."""
    packed = rows.groupBy(key).agg(F.sum("w").alias("total"), F.collect_list(F.struct("digest", "w")).alias("items"))
    x = packed.select(F.col(key).alias("a"), F.col("total").alias("ta"), F.col("items").alias("ia"))
    y = packed.select(F.col(key).alias("b"), F.col("total").alias("tb"), F.col("items").alias("ib"))
    both = F.array_intersect("ia", "ib")
    shared = F.aggregate(both, F.lit(0).cast("bigint"), lambda s, i: s + i["w"])
    return pairs.join(x, "a").join(y, "b").withColumn("shared_w", shared).select("a", "b", "shared_w", (F.col("ta") + F.col("tb") - F.col("shared_w")).alias("union_w"))


def similar_units(rows: DataFrame, key: str, num: int, den: int, work: Workspace) -> DataFrame:
    """(a, b, shared_w, union_w), a < b: all pairs of sets whose weighted similarity is num / den or more. Exact."""
    found = work.write(candidates(rows, key, num, den), "candidates")
    return scored(found, rows, key).where(reaches(F.col("shared_w"), F.col("union_w"), num, den))


def explained(rows: DataFrame, key: str, a: int, b: int) -> DataFrame:
    """One row on two sets: weights shared and united, and digests shared and united."""
    two = rows.where(F.col(key).isin(a, b)).groupBy("digest").agg(F.max("w").alias("w"), F.count("*").alias("n"))
    shared = F.col("n") == 2
    one = F.coalesce(F.sum(F.when(shared, F.col("w"))), F.lit(0)).alias("shared_w")
    return two.agg(one, F.coalesce(F.sum("w"), F.lit(0)).alias("union_w"), F.count(F.when(shared, 1)).alias("shared_digests"), F.count("*").alias("union_digests")).select(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"), "*")


__all__ = ["candidates", "explained", "scored", "similar_units", "totals", "weighted_sets"]
