from twinspan.operators.fingerprints import digest_counts
from twinspan.streaming import incremental

SCHEMA = "key bigint, rev int, digests array<bigint>"
BATCHES = [
    [(1, 1, [1, 2, 2]), (2, 1, [1, 3]), (3, 1, None)],
    [(1, 2, [2, 4]), (1, 2, [2, 4]), (4, 1, []), (None, 1, [9])],
    [(2, 0, [7]), (3, 2, [1]), (2, None, [8])],
]
FINAL = {1: [2, 4], 2: [1, 3], 3: [1], 4: []}


def expected(spark):
    df = spark.createDataFrame(list(FINAL.items()), "key bigint, digests array<bigint>")
    return sorted(map(tuple, digest_counts(df).collect()))


def test_batches_again_give_the_same(spark, tmp_path):
    folder = str(tmp_path / "state")
    for number, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, SCHEMA)
        incremental.apply_batch(batch, number, folder)
        incremental.apply_batch(batch, number, folder)
    assert sorted(map(tuple, incremental.counts(spark, folder).collect())) == expected(spark)
    assert {r["key"] for r in incremental.changed_units(spark, folder, 2).collect()} == {2, 3}


def test_stream(spark, tmp_path):
    folder, source = str(tmp_path / "state"), str(tmp_path / "in")
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        incremental.maintain(stream, folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, incremental.counts(spark, folder).collect())) == expected(spark)
