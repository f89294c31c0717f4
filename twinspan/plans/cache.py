"""Summaries of a base snapshot, kept as tables under a key of all that they depend on."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Version of the tables' layout.
FORMAT = 1
SCHEMAS = {
    "clusters": "key string, cluster bigint",
    "structures": "structural string, cluster bigint",
    "pairs": "ka string, kb string, sa string, sb string, score double, a string, b string",
    "clauses": "key string",
}


def cache_key(commit: str, normalizer: int, include_tests: bool, prefix: str, contract: str, overrides: dict | None = None) -> str:
    """A hash of what a base summary depends on."""
    parts = [FORMAT, commit, normalizer, include_tests, prefix, contract, sorted((overrides or {}).items())]
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def write(tables: dict[str, DataFrame], root: str, key: str) -> bool:
    """Write a summary under a name of its own and then give it its name, so it is there as a whole or not at all. False, and
    nothing left behind, where that fails."""
    spark = next(iter(tables.values())).sparkSession
    made, folder = (spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{x}") for x in (f"_{key}-{uuid.uuid4().hex}", key))
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, schema in SCHEMAS.items():
            columns = [part.split()[0] for part in schema.split(", ")]
            tables[name].select(*columns).write.parquet(f"{made.toString()}/{name}")
        spark.createDataFrame([(FORMAT, key)], "format int, key string").coalesce(1).write.parquet(f"{made.toString()}/complete")
        system.delete(folder, True)
        return system.rename(made, folder)
    except Exception:  # noqa: BLE001 - a cache that can't be written is done without
        return False
    finally:
        try:
            system.delete(made, True)
        except Exception:  # noqa: BLE001 - it could not be made either
            pass


def read(spark: SparkSession, root: str, key: str) -> dict[str, DataFrame] | None:
    """A whole summary of this layout, or None: absent, unfinished, of another layout, or damaged."""
    folder = f"{root.rstrip('/')}/{key}"
    try:
        if [tuple(r) for r in spark.read.parquet(f"{folder}/complete").collect()] != [(FORMAT, key)]:
            return None
        out = {}
        for name, schema in SCHEMAS.items():
            table = spark.read.parquet(f"{folder}/{name}")
            if [f"{n} {t}" for n, t in table.dtypes] != schema.split(", "):
                return None
            out[name] = table
    except Exception:  # noqa: BLE001 - what can't be read is no summary
        return None
    return out
