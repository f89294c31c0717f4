"""Declared exceptions and settings: which units a reference names, which matches a clause keeps.

References: (ref_id, text, path, line); units: (entry_id, identity, namespace, kind, ...). References come from documents
that people write, so they are few next to units; they are broadcast only while their number is under BROADCAST_REFS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.functions.references import glob_depth, reference_kind, specificity, template_matches

BROADCAST_REFS = 20_000
#: Most references that may be wildcards alone, as "*::*".
MOST_WILD = 1000


def reference_hits(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(ref_id, entry_id): the units that each reference names.

    Methods join by identity, constants by namespace or one it lies in, both as equality joins; globs meet distinct
    namespaces or template identities, not units.
    """
    known = refs.where("text is not null").withColumn("kind", reference_kind(F.col("text")))
    few = known.limit(BROADCAST_REFS + 1).count() <= BROADCAST_REFS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    methods = known.where("kind = 'method'").select("ref_id", F.col("text").alias("identity"))
    hit = units.select("entry_id", "identity").join(small(methods), "identity").select("ref_id", "entry_id")
    named = units.where("namespace is not null and kind <> 'template'").select("entry_id", "namespace")
    parts = F.split("namespace", "::")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "::"))
    constants = known.where("kind = 'constant'").select("ref_id", F.col("text").alias("name"))
    hit = hit.unionByName(named.select("entry_id", F.explode(above).alias("name")).join(small(constants), "name").select("ref_id", "entry_id"))
    spaces = named.select("namespace").distinct()
    globs = known.where("kind = 'const_glob'").select("ref_id", "text")
    met = _by_first(spaces, globs, "namespace", "::", small).where(glob_depth("text", "namespace").isNotNull()).select("ref_id", "namespace")
    hit = hit.unionByName(named.join(met, "namespace").select("ref_id", "entry_id"))
    templates = units.where("kind = 'template'").select("entry_id", "identity")
    shapes = known.where("kind = 'template_glob'").select("ref_id", "text")
    wide = _by_first(templates, shapes, "identity", "/", small).where(template_matches("text", "identity")).select("ref_id", "entry_id")
    return hit.unionByName(wide).distinct()


def _by_first(names: DataFrame, globs: DataFrame, name: str, mark: str, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Names with the globs that may match them, by equality joins: on the first segment of globs whose first is literal, and
    on any segment for the others that have a literal one. Globs of wildcards alone, which may match all names, are few."""
    parts = F.split("text", mark)
    literal = F.filter(parts, lambda x: ~x.rlike(r"[*?\[]"))
    cut = globs.withColumn("_literal", literal)
    fixed = cut.where((F.size("_literal") > 0) & (F.element_at("_literal", 1) == parts[0])).select("ref_id", "text", parts[0].alias("_first"))
    inner = cut.where((F.size("_literal") > 0) & (F.element_at("_literal", 1) != parts[0])).select("ref_id", "text", F.element_at("_literal", -1).alias("_part"))
    wild = [(r["ref_id"], r["text"]) for r in cut.where(F.size("_literal") == 0).select("ref_id", "text").distinct().limit(MOST_WILD + 1).collect()]
    if len(wild) > MOST_WILD:
        raise ValueError(f"more than {MOST_WILD} references are wildcards alone")
    own = F.split(name, mark)
    keyed = names.withColumn("_first", own[0]).join(small(fixed), "_first").drop("_first")
    met = names.withColumn("_part", F.explode(F.array_distinct(own))).join(small(inner), "_part").drop("_part")
    out = keyed.unionByName(met.select(*keyed.columns))
    if wild:
        listed = F.array(*(F.struct(F.lit(k).cast(globs.schema["ref_id"].dataType).alias("ref_id"), F.lit(t).alias("text")) for k, t in wild))
        out = out.unionByName(names.withColumn("_w", F.explode(listed)).select(*names.columns, "_w.ref_id", "_w.text").select(*keyed.columns))
    return out


def unknown_references(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """References that name no unit."""
    return refs.join(hits, "ref_id", "left_anti")


def assigned(hits: DataFrame, clause_refs: DataFrame) -> DataFrame:
    """(clause_id, entry_id, text): per clause and unit the most specific reference that names it. clause_refs: (clause_id,
    ref_id, text)."""
    rank = F.row_number().over(Window.partitionBy("clause_id", "entry_id").orderBy(F.col("spec").desc(), "ref_id"))
    each = hits.join(clause_refs.withColumn("spec", specificity(F.col("text"))), "ref_id")
    return each.withColumn("_k", rank).where("_k = 1").select("clause_id", "entry_id", "text")


def primitive_of(hits: DataFrame, covers: DataFrame) -> DataFrame:
    """(entry_id, primitive): the primitive whose most specific reference covers a unit; of equals the first name. covers:
    (primitive, ref_id, text)."""
    rank = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.col("spec").desc(), "primitive"))
    each = hits.join(covers.withColumn("spec", specificity(F.col("text"))), "ref_id")
    return each.withColumn("_k", rank).where("_k = 1").select("entry_id", "primitive")


def kept(matches: DataFrame, assignment: DataFrame, clauses: DataFrame) -> DataFrame:
    """(match_id, clause_id): matches whose two units one clause names by different references; of several clauses the first
    by path and line. matches: (match_id, ea, eb)."""
    x = assignment.select("clause_id", F.col("entry_id").alias("ea"), F.col("text").alias("_ta"))
    y = assignment.select("clause_id", F.col("entry_id").alias("eb"), F.col("text").alias("_tb"))
    both = matches.where("ea <> eb").join(x, "ea").join(y, ["eb", "clause_id"]).where("_ta <> _tb")
    first = F.min_by("clause_id", F.struct("path", "line", "clause_id"))
    return both.join(clauses.select("clause_id", "path", "line"), "clause_id").groupBy("match_id").agg(first.alias("clause_id"))


def unkept_twins(kept_pairs: DataFrame, members: DataFrame, assignment: DataFrame) -> DataFrame:
    """(ea, eb): pairs of units that a kept match between members of groups of identical units leaves unkept.

    kept_pairs: (ga, gb), the groups of kept matches of whole units; members: (group, entry_id). A kept match says nothing of
    the other members of its groups: those pairs of them that no clause keeps are duplication. Members that clauses name
    alike are one class. Two of one class are never kept, and two classes are kept or not as wholes, so hubs of classes
    stand for all pairs: each unkept pair is joined through them, with edges linear in the members.
    """
    groups = kept_pairs.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct()
    named = assignment.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct("clause_id", "text"))).alias("names"))
    own = members.distinct().join(named, "entry_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<clause_id:int,text:string>>")))
    classes = own.groupBy("group", "names").agg(F.min("entry_id").alias("hub"))
    own = own.join(classes, ["group", "names"])
    x = classes.select(F.col("group").alias("ga"), F.col("names").alias("na"), F.col("hub").alias("ha"))
    y = classes.select(F.col("group").alias("gb"), F.col("names").alias("nb"), F.col("hub").alias("hb"))
    apart = F.exists("na", lambda i: F.exists("nb", lambda j: (i["clause_id"] == j["clause_id"]) & (i["text"] != j["text"])))
    across = groups.join(x, "ga").join(y, "gb").where(~apart)
    left = own.select(F.col("group").alias("ga"), F.col("hub").alias("ha"), F.col("entry_id").alias("ea"))
    right = own.select(F.col("group").alias("gb"), F.col("hub").alias("hb"), F.col("entry_id").alias("eb"))
    edges = across.join(right, ["gb", "hb"]).select(F.col("ha").alias("ea"), "eb").unionByName(across.join(left, ["ga", "ha"]).select("ea", F.col("hb").alias("eb")))
    return edges.where("ea <> eb").select(F.least("ea", "eb").alias("ea"), F.greatest("ea", "eb").alias("eb")).distinct()


def stale(clauses: DataFrame, keeping: DataFrame) -> DataFrame:
    """Clauses that keep nothing."""
    return clauses.join(keeping, "clause_id", "left_anti")


def new_clauses(clauses: DataFrame, base_keys: DataFrame) -> DataFrame:
    """Clauses whose key the base didn't have."""
    return clauses.join(base_keys.select("key").distinct(), "key", "left_anti")


def unit_settings(units: DataFrame, settings: DataFrame, by: str, defaults: tuple[int, int, int] = (800_000, 4, 20)) -> DataFrame:
    """Add threshold (millionths), min_lines and min_nodes to units: their group's settings, else the defaults."""
    threshold, lines, nodes = defaults
    own = settings.select(by, F.col("threshold").alias("_t"), F.col("min_lines").alias("_l"), F.col("min_nodes").alias("_n"))
    rest = [c for c in units.columns if c not in ("threshold", "min_lines", "min_nodes")]
    joined = units.select(*rest).join(own, by, "left")
    return joined.select(*rest, F.coalesce("_t", F.lit(threshold)).cast("bigint").alias("threshold"), F.coalesce("_l", F.lit(lines)).alias("min_lines"), F.coalesce("_n", F.lit(nodes)).alias("min_nodes"))


def floors(settings: DataFrame, defaults: tuple[int, int, int] = (800_000, 4, 20)) -> DataFrame:
    """One row: the loosest threshold, lines and nodes over the defaults and every group's settings."""
    least = lambda c, d: F.least(F.coalesce(F.min(c), F.lit(d)), F.lit(d)).cast("bigint").alias(c)
    return settings.agg(least("threshold", defaults[0]), least("min_lines", defaults[1]), least("min_nodes", defaults[2]))
