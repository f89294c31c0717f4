"""Joins whose keys may be held by a large share of all rows, and numbers in order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.work import Workspace

#: A key is hot when it holds more than one in HOT of all rows, so there are fewer than HOT hot keys, whatever the data.
HOT = 2000
#: Rows that one task takes easily: a key with no more is never hot.
EASY = 1_000_000


def lookup_by_count(rows: DataFrame, stats: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with stats, which has each key once and, in ``count``, how many rows hold it.

    Keys held by more than ``total / HOT`` rows are joined by broadcast: there are at most HOT of them. The others are
    joined by a shuffle in which no key has more than ``total / HOT`` rows. Nothing is dropped.
    """
    bound = max(total // HOT, 1)
    hot = F.broadcast(stats.where(F.col(count) > bound))
    cold = rows.join(F.broadcast(stats.where(F.col(count) > bound).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(stats.where(F.col(count) <= bound), key))


def lookup(rows: DataFrame, stats: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows, best a written table, with stats, which has each key once, where keys may be hot in rows.

    The hot keys are counted, with a partial count where the rows are; there are fewer than HOT of them. Null keys are never
    hot, as they meet nothing.
    """
    keys = [key] if isinstance(key, str) else key
    total = rows.count()  # of a written table it is read from the files' footers
    if total <= EASY:
        return rows.join(stats, keys, how)
    counts = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    found = counts.where(F.col("_n") > max(total // HOT, EASY)).select(*keys)
    hot = found.collect()
    if not hot:
        return rows.join(stats, keys, how)
    listed = F.broadcast(rows.sparkSession.createDataFrame(hot, found.schema))
    split = rows.join(listed, keys, "left_semi").join(F.broadcast(stats.join(listed, keys, "left_semi")), keys, how)
    return split.unionByName(rows.join(listed, keys, "left_anti").join(stats, keys, how))


def in_order(rows: DataFrame, by: str, number: str, work: Workspace) -> DataFrame:
    """rows with a BIGINT column of their places, from 0, in the order of ``by``: a sort by ranges, and counts of the ranges."""
    cut = work.write(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = cut.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(number, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")
