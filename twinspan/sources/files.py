"""Source files of a folder or a table: listing, filtering and reading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions import paths


def walked(root: str) -> list[str]:
    """Paths of the regular files under a folder, in order; no symbolic link is followed or listed."""
    out = []
    for folder, _, names in os.walk(root, followlinks=False):
        for name in names:
            full = os.path.join(folder, name)
            if os.path.isfile(full) and not os.path.islink(full):
                out.append(os.path.relpath(full, root))
    return sorted(out)


def linked(root: str, path: str) -> bool:
    """Is a part of the path a symbolic link?"""
    parts = path.split("/")
    return any(os.path.islink(os.path.join(root, *parts[: k + 1])) for k in range(len(parts)))


def read_files(spark: SparkSession, root: str, listing: list[str] | None = None) -> DataFrame:
    """(path, content BINARY) of a folder's files, or of those listed; read in parallel by the executors."""
    if listing is None:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        prefix = "file:" + os.path.realpath(root).rstrip("/") + "/"
        return read.select(F.regexp_replace("path", "^" + prefix.replace(".", r"\."), "").alias("path"), "content")
    existing = [os.path.join(root, p) for p in listing if os.path.isfile(os.path.join(root, p)) and not linked(root, p)]
    if not existing:
        return spark.createDataFrame([], "path string, content binary")
    read = spark.read.format("binaryFile").load(existing)
    return read.select(F.expr(f"substring(path, {len('file:' + root.rstrip('/') + '/') + 1})").alias("path"), "content")


def source_files(files: DataFrame, include_tests: bool = False, content: str | None = None) -> DataFrame:
    """Files in a language, allowed, not tests unless asked for, and not generated; path is the column path, each once."""
    path = F.col("path")
    kept = files.withColumn("language", paths.language(path)).where(F.col("language").isNotNull() & paths.allowed(path))
    if not include_tests:
        kept = kept.where(~paths.is_test(path))
    if content:
        kept = kept.where(~paths.generated(F.col(content)))
    return kept.dropDuplicates(["path"])


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text, ...) of files that are valid UTF-8, and (path, line, message) of the others, at their first bad line."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(valid).withColumn("text", F.col("content").cast("string")).drop("content")

    @F.pandas_udf("int")
    def bad_line(contents):  # noqa: ANN001, ANN202
        def line(raw: bytes) -> int:
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError as e:
                return raw.count(b"\n", 0, e.start) + 1
            return 1

        return contents.map(line)

    bad = files.where(~valid).select("path", bad_line("content").alias("line"), F.lit("file is not valid UTF-8").alias("message"))
    return good, bad
