"""Identical units: groups, stars in place of all pairs, and stand-ins.

Units: (entry_id, root_digest, repo or other settings columns, path, start_line, end_line, node_count, threshold,
min_lines, min_nodes). A group of n identical units gives fewer than 2 n edges for each pair of settings classes, never
n * n; every pair that its own settings allow is connected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.fragments import class_stars
from twinspan.operators.skew import lookup


def identical_groups(units: DataFrame) -> DataFrame:
    """(root_digest, members, first_id) of the digests that two units or more have."""
    known = units.where("root_digest is not null")
    return known.groupBy("root_digest").agg(F.count("*").alias("members"), F.min("entry_id").alias("first_id")).where("members >= 2")


def identical_stars(units: DataFrame) -> DataFrame:
    """(root_digest, a, b), a < b: per group and pair of settings classes, every unit that meets the pair's floors joined to
    one of the other class that does and that it doesn't overlap, wherever there is one. See ``fragments.class_stars``."""
    known = units.where("root_digest is not null")
    stars = class_stars(known.select(F.col("root_digest").alias("signature"), F.col("entry_id").alias("loc_id"), "path", "start_line", "end_line", F.col("node_count").alias("size"), "min_lines", "min_nodes"))
    return stars.withColumnRenamed("signature", "root_digest")


def representatives(units: DataFrame) -> DataFrame:
    """(entry_id, rep_id): per root digest, settings and lines, the first unit stands for all; units without a digest stand
    for themselves."""
    lines = (F.col("end_line") - F.col("start_line") + 1).alias("lines")
    own = F.xxhash64("threshold", "min_lines", "min_nodes", lines)  # of a digest's few settings and numbers of lines
    cut = units.select("entry_id", F.coalesce("root_digest", F.concat(F.lit("#"), F.col("entry_id"))).alias("bucket"), own.alias("own"))
    return lookup(cut, cut.groupBy("bucket", "own").agg(F.min("entry_id").alias("rep_id")), ["bucket", "own"]).select("entry_id", "rep_id")


def stood_in(pairs: DataFrame, reps: DataFrame, star: DataFrame) -> DataFrame:
    """Near pairs of representatives, each fanned out to the bucket members that no star joins to their representative.

    pairs: (a, b, ...) of representatives. Linear in the members: a member is joined to the other side's representative.
    """
    tied = star.select(F.explode(F.array("a", "b")).alias("entry_id")).distinct()
    alone = reps.where("entry_id <> rep_id").join(tied, "entry_id", "left_anti")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    left = pairs.join(alone, F.col("a") == F.col("rep_id")).select(F.least("entry_id", "b").alias("a"), F.greatest("entry_id", "b").alias("b"), *rest)
    right = pairs.join(alone, F.col("b") == F.col("rep_id")).select(F.least("entry_id", "a").alias("a"), F.greatest("entry_id", "a").alias("b"), *rest)
    return pairs.unionByName(left).unionByName(right).distinct()
