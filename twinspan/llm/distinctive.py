"""Problem 1: how distinctive a term is per record.

Log-odds ratio of the record against the rest of the collection with an informative Dirichlet prior, divided by its
standard error (Monroe, Colaresi and Quinn 2008). The prior of a term is ``scale`` times its count in the collection.
With scale 1 the score of a term that occurs once in its record falls strictly with the number of records that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.digests import digest_text, effective_sets
from twinspan.operators.skew import lookup_by_count
from twinspan.sources.tables import counting_rows, table
from twinspan.work import Workspace


def z_score(y: Column, n: Column, df: Column, total: Column, scale: float) -> Column:
    """z of a term that occurs y times among the record's n and df times among the collection's total."""
    a, a0 = df * F.lit(scale), total * F.lit(scale)
    inside, outside = y + a, df - y + a
    least = F.lit(1e-9)  # of a collection of one term nothing else is left
    delta = F.log(inside / F.greatest(n + a0 - inside, least)) - F.log(outside / F.greatest(total - n + a0 - outside, least))
    return delta / F.sqrt(1 / inside + 1 / outside)


def term_scores(records: DataFrame, key: str, terms: str, work: Workspace, scale: float = 1.0) -> DataFrame:
    """(key, term, set_size, df, z) of every term of every record.

    ``terms`` is an array of distinct terms; null and empty arrays give no row, null terms neither. Counts cover every
    record. ``df`` is the number of records that hold the term. Other columns of records are ignored.
    """
    base = work.write(records.select(key, F.col(terms).alias("_t")).where(F.size("_t") > 0), "records")
    rows = base.select(key, F.size("_t").alias("set_size"), F.explode("_t").alias("term")).where("term is not null")
    stats = work.write(rows.groupBy("term").agg(F.count("*").alias("df")), "stats")
    total = stats.agg(F.sum("df")).first()[0] or 0
    joined = lookup_by_count(rows, stats, "term", "df", total)
    z = z_score(F.lit(1.0), F.col("set_size"), F.col("df").cast("double"), F.lit(float(total)), scale)
    return joined.select(key, "term", "set_size", "df", z.alias("z"))


def entry_sets(spark, sf_dir: str) -> DataFrame:
    """(entry_id, digests) of the counting row of each entry."""
    entries = table(spark, sf_dir, "entries").select("entry_id", "rev", "fp_set")
    return counting_rows(effective_sets(entries, "fp_set"), "entry_id").drop("rev")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Per entry with a set of five or more, its highest-scored digest among those that other entries hold too."""
    scores = term_scores(entry_sets(spark, sf_dir), "entry_id", "digests", Workspace(spark, "p1"))
    shared = scores.where("df >= 2 and set_size >= 5")
    best = shared.groupBy("entry_id").agg(F.min(F.struct(-F.col("z"), "df", "term")).alias("best"))
    return best.select("entry_id", digest_text("best.term").alias("digest"))


def p1_scores(spark, sf_dir: str) -> DataFrame:
    """Every digest of every entry with its score."""
    scores = term_scores(entry_sets(spark, sf_dir), "entry_id", "digests", Workspace(spark, "p1"))
    return scores.select("entry_id", digest_text("term").alias("digest"), "df", "set_size", F.round("z", 6).alias("z"))
