"""Digest counts kept current over a stream of unit revisions.

A weight depends on its digest's count alone, so a stream of revisions changes only the digests of the units in it. Each
micro-batch writes, under its own number, the sets it brings and the counts it changes; a batch that is run again after a
failure writes the same tables again, so counts are exact. Revisions may come late, repeated and out of order: of a unit the
greatest revision counts, whenever it comes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinspan.functions.weights import weight

SETS = "key bigint, rev int, digests array<bigint>, batch bigint"
DELTAS = "digest bigint, delta bigint, batch bigint"


def _table(spark: SparkSession, folder: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("batch") < before)


def _latest(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rev"), "batch"))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def apply_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Take in a micro-batch (key, rev, digests); null sets hold nothing."""
    spark = batch.sparkSession
    new = _latest(batch.where("key is not null").select("key", F.coalesce("rev", F.lit(-1)).alias("rev"), F.array_distinct(F.coalesce("digests", F.array().cast("array<bigint>"))).alias("digests"), F.lit(number).cast("bigint").alias("batch")))
    old = _latest(_table(spark, folder, "sets", SETS, number).join(new.select("key").distinct(), "key", "left_semi"))
    old = old.select("key", F.col("rev").alias("_rev"), F.col("digests").alias("_old"))
    taken = new.join(old, "key", "left").where("_rev is null or rev > _rev")
    taken.select("key", "rev", "digests").write.mode("overwrite").parquet(f"{folder}/sets/batch={number}")
    gained = taken.select(F.explode("digests").alias("digest"), F.lit(1).alias("delta"))
    lost = taken.where("_old is not null").select(F.explode("_old").alias("digest"), F.lit(-1).alias("delta"))
    change = gained.unionByName(lost).groupBy("digest").agg(F.sum("delta").cast("bigint").alias("delta")).where("delta <> 0")
    change.write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, df, w) after all batches so far."""
    total = _table(spark, folder, "deltas", DELTAS).groupBy("digest").agg(F.sum("delta").alias("df")).where("df > 0")
    return total.withColumn("w", weight("df"))


def changed_units(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(key): units that hold a digest whose count the batch changed, the only ones whose pairs need scoring again."""
    moved = _table(spark, folder, "deltas", DELTAS).where(F.col("batch") == number).select("digest")
    sets = _latest(_table(spark, folder, "sets", SETS))
    return sets.select("key", F.explode("digests").alias("digest")).join(moved, "digest", "left_semi").select("key").distinct()


def maintain(stream: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start keeping counts from a stream of (key, rev, digests)."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, folder)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
