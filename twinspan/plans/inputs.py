"""The project's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.digests import digest_number, digest_text, effective_sets
from twinspan.functions.weights import exact_threshold
from twinspan.operators.contract import unit_settings
from twinspan.sources.frontends import text_fingerprints
from twinspan.sources.tables import counting_rows, table


def unit_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(entry_id, digests) of units with a set."""
    sets = effective_sets(table(spark, folder, "entries").select("entry_id", "rev", "fp_set"), "fp_set")
    return counting_rows(sets, "entry_id").drop("rev").where("size(digests) > 0")


def repo_settings(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, threshold in millionths, min_lines, min_nodes); null where a repository sets none."""
    return table(spark, folder, "repos").select("repo", exact_threshold(F.col("threshold")).alias("threshold"), "min_lines", "min_nodes")


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Units with their identity, place, root digest (16 digits) and settings."""
    rows = counting_rows(table(spark, folder, "entries").drop("fp_set"), "entry_id")
    cut = rows.select(
        "entry_id", "repo", F.col("unit_kind").alias("kind"), F.col("unit_identity").alias("identity"), F.col("unit_namespace").alias("namespace"), F.col("file_path").alias("path"),
        "start_line", "end_line", F.col("file_language").alias("language"), digest_text(digest_number("root_digest")).alias("root_digest"), "node_count",
    )
    return unit_settings(cut, repo_settings(spark, folder), "repo")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Locations, each once: (loc_id, entry_id, repo, path, lines, size, whole, signature, ordinal, key)."""
    return table(spark, folder, "locations").select(
        "loc_id", "entry_id", "repo", F.col("file_path").alias("path"), "start_line", "end_line", F.col("node_count").alias("size"), F.col("is_whole").alias("whole"),
        digest_text(digest_number("signature")).alias("signature"), F.col("ordinal_no").alias("ordinal"), F.concat_ws("|", "repo", "loc_key").alias("key"),
    ).dropDuplicates(["loc_id"])


def score_value(score: Column, shared: Column, united: Column) -> Column:
    """A recorded score as a number, for ordering and display."""
    text = F.trim(score)
    ratio = F.split(text, "/")
    of_ratio = F.try_divide(F.try_element_at(ratio, F.lit(1)).try_cast("double"), F.try_element_at(ratio, F.lit(2)).try_cast("double"))
    of_percent = F.regexp_replace(text, "%$", "").try_cast("double") / 100
    of_weights = F.try_divide(shared.cast("double"), united.cast("double"))
    return F.when(text.isNull() | (text == ""), of_weights).when(text.contains("/"), of_ratio).when(text.endswith("%"), of_percent).otherwise(text.try_cast("double"))


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """(match_id, a, b, match_kind, score) of the matches that exist, have both sides, and join two locations."""
    rows = counting_rows(table(spark, folder, "matches"), "match_id").where("not coalesce(withdrawn, false) and a is not null and b is not null and a <> b")
    value = score_value(F.col("score"), F.col("shared_w"), F.col("union_w"))
    return rows.select("match_id", "a", "b", "match_kind", F.coalesce(value, F.lit(0.0)).alias("score"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(seq_id, digests, starts, ends): each document's lines that aren't blank, and their numbers."""
    found = text_fingerprints(table(spark, folder, "documents").where("doc_id is not null"), "doc_id", "text")
    return found.select(F.col("doc_id").alias("seq_id"), F.col("lines").alias("digests"), F.col("at").alias("starts"), F.col("at").alias("ends")).where("size(digests) > 0")


def line_places(spark: SparkSession, folder: str) -> DataFrame:
    """(loc_id, signature, path, start_line, end_line): every line of every document as a fragment of one line."""
    lines = document_lines(spark, folder).select("seq_id", F.explode(F.arrays_zip("digests", "starts")).alias("x"))
    line = F.col("x.starts")
    return lines.select((F.col("seq_id") * (1 << 20) + line).alias("loc_id"), F.col("x.digests").alias("signature"), F.col("seq_id").cast("string").alias("path"), line.alias("start_line"), line.alias("end_line"))


def changed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, from_line, to_line): lines that count as changed, the ten from each recorded parse error."""
    rows = table(spark, folder, "parse_errors").where("file_path is not null and line_no is not null")
    return rows.select(F.col("file_path").alias("path"), F.col("line_no").alias("from_line"), (F.col("line_no") + 9).alias("to_line")).distinct()


def line_ages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line, ts): every line of every file with its commit time in seconds."""
    rows = counting_rows(table(spark, folder, "source_files"), "file_id").where("content is not null")
    lines = F.sequence(F.lit(1), F.size(F.split("content", "\n")))
    return rows.select(F.col("file_path").alias("path"), F.explode(lines).alias("line"), F.unix_seconds(F.col("committed_at").cast("timestamp")).alias("ts"))
