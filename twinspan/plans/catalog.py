"""Queries of the core operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions import paths
from twinspan.functions.digests import digest_text
from twinspan.operators import clusters, contract, findings, fingerprints, fragments, identical, similarity
from twinspan.plans import inputs, oracles, report
from twinspan.plans.sweep import sweep
from twinspan.sources import documents, frontends, units
from twinspan.sources.files import source_files
from twinspan.sources.tables import counting_rows, table
from twinspan.work import Workspace

FLAGSHIP = "unit_sim_pairs"
LANGUAGES = {"html": r"\.erb$", "json": r"\.json$", "python": r"\.py$"}


def _weighted(spark: SparkSession, folder: str, work: Workspace) -> DataFrame:
    return similarity.weighted_sets(inputs.unit_sets(spark, folder), "entry_id", work)


def src_filter(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").where("file_path is not null").select(F.col("file_path").alias("path"))
    return source_files(files).select("path", "language")


def src_flags(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("file_path")
    flags = (paths.language(path).alias("language"), paths.allowed(path).alias("allowed"), paths.is_test(path).alias("test"), paths.snake_case(paths.base_name(path)).alias("snake"))
    return table(spark, folder, "entries").where(path.isNotNull()).select(path.alias("path"), *flags).distinct()


def generated_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = counting_rows(table(spark, folder, "source_files"), "file_id")
    return rows.select("file_id", paths.generated(F.col("content")).alias("generated"))


def digest_weights(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.digest_counts(inputs.unit_sets(spark, folder)).select(digest_text("digest").alias("digest"), "df", "w")


def entry_totals(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.totals(_weighted(spark, folder, Workspace(spark, "totals")), "entry_id")


def prefix_digests(spark: SparkSession, folder: str) -> DataFrame:
    rare = fingerprints.prefixes(_weighted(spark, folder, Workspace(spark, "prefix")), "entry_id", 4, 5)
    return rare.select("entry_id", digest_text("digest").alias("digest"), "total")


def unit_sim_pairs(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "units")
    return similarity.similar_units(_weighted(spark, folder, work), "entry_id", 4, 5, work)


def unit_sim_pairs_65(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "units")
    return similarity.similar_units(_weighted(spark, folder, work), "entry_id", 13, 20, work)


def mixed_threshold_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that reach the lower of their two thresholds, with both sides at or above the lower floors, not overlapping."""
    work = Workspace(spark, "mixed")
    own = work.write(inputs.units(spark, folder), "units")
    floor = contract.floors(inputs.repo_settings(spark, folder)).first()
    pairs = similarity.similar_units(_weighted(spark, folder, work), "entry_id", floor["threshold"], 1_000_000, work)
    side = lambda x: own.select(*(F.col(c).alias(f"{x}_{c}") for c in ("entry_id", "path", "start_line", "end_line", "node_count", "threshold", "min_lines", "min_nodes"))).withColumnRenamed(f"{x}_entry_id", x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    lines = lambda x: F.col(f"{x}_end_line") - F.col(f"{x}_start_line") + 1
    floors = (F.least(lines("a"), lines("b")) >= F.least("a_min_lines", "b_min_lines")) & (F.least("a_node_count", "b_node_count") >= F.least("a_min_nodes", "b_min_nodes"))
    enough = F.col("shared_w").cast("decimal(20,0)") * 1_000_000 >= F.col("union_w").cast("decimal(20,0)") * F.least("a_threshold", "b_threshold")
    clash = (F.col("a_path") == F.col("b_path")) & (F.col("a_start_line") <= F.col("b_end_line")) & (F.col("b_start_line") <= F.col("a_end_line"))
    return both.where(floors & enough & ~clash).select("a", "b", "shared_w", "union_w")


def basket_sim_pairs(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "baskets")
    baskets = frontends.basket_sets(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey")
    return similarity.similar_units(similarity.weighted_sets(baskets, "l_orderkey", work), "l_orderkey", 4, 5, work)


def document_sim_pairs(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "documents")
    sets = work.write(frontends.text_fingerprints(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "digests"), "sets")
    return similarity.similar_units(similarity.weighted_sets(sets, "doc_id", work), "doc_id", 4, 5, work)


def explain_pair(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.explained(_weighted(spark, folder, Workspace(spark, "explain")), "entry_id", 1, 2)


def identical_groups(spark: SparkSession, folder: str) -> DataFrame:
    return identical.identical_groups(inputs.units(spark, folder))


def identical_star(spark: SparkSession, folder: str) -> DataFrame:
    """Identical units that their settings allow to pair, with the least unit they are connected to by stars."""
    work = Workspace(spark, "stars")
    star = work.write(identical.identical_stars(inputs.units(spark, folder)), "star")
    linked = clusters.components(star, "a", "b", work).withColumnsRenamed({"id": "entry_id", "component": "group_id"})
    return linked.join(star.select(F.col("a").alias("group_id"), "root_digest").distinct(), "group_id").select("root_digest", "entry_id", "group_id")


def bucket_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return identical.representatives(inputs.units(spark, folder))


def stand_in_pairs(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "standins")
    own = work.write(inputs.units(spark, folder), "units")
    reps, star = work.write(identical.representatives(own), "reps"), work.write(identical.identical_stars(own), "star")
    first = reps.where("entry_id = rep_id").select("entry_id")
    rows = similarity.weighted_sets(inputs.unit_sets(spark, folder), "entry_id", work).join(first, "entry_id", "left_semi")
    return identical.stood_in(similarity.similar_units(rows, "entry_id", 4, 5, work), reps, star)


def fragment_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that occur more than once in the documents."""
    rows = inputs.line_places(spark, folder)
    return rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("loc_id").alias("first_id")).where("n >= 2").select("first_id", "n")


def fragment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of equal lines of the documents; of lines that occur more than 100 times a star."""
    return fragments.fragment_pairs(Workspace(spark, "lines").write(inputs.line_places(spark, folder), "places")).select("a", "b")


def fragment_links(spark: SparkSession, folder: str) -> DataFrame:
    """Equal lines of the documents, connected by pairs and stars under two settings: lines of two documents with odd numbers
    are too small for each other's floor, so only pairs with a document of an even number are allowed."""
    work = Workspace(spark, "lines")
    rows = inputs.line_places(spark, folder)
    odd = F.col("path").cast("bigint") % 2 == 1
    placed = work.write(rows.withColumns({"size": F.lit(5), "min_lines": F.lit(1), "min_nodes": F.when(odd, F.lit(6)).otherwise(F.lit(1))}), "places")
    edges = work.write(fragments.fragment_pairs(placed, cap=3).join(placed.select(F.col("loc_id").alias("a"), F.col("min_nodes").alias("ma")), "a").join(placed.select(F.col("loc_id").alias("b"), F.col("min_nodes").alias("mb")), "b").where("least(ma, mb) <= 5"), "edges")
    return clusters.components(edges, "a", "b", work).withColumnsRenamed({"id": "loc_id", "component": "group_id"})


def _subtrees(spark: SparkSession, folder: str) -> DataFrame:
    """The subtrees, but whole trees, of the ERB, JSON and Python files that are large enough for a fragment."""
    places = _trees(spark, folder).where("parent >= 0 and size >= 20")
    return places.select(F.xxhash64("entry_id", "preorder").alias("loc_id"), F.col("entry_id").cast("string").alias("path"), "start_line", "end_line", "size", F.col("digest").alias("signature"))


def subtree_pairs(spark: SparkSession, folder: str) -> DataFrame:
    places = Workspace(spark, "subtrees").write(_subtrees(spark, folder), "places")
    return fragments.fragment_pairs(places.withColumns({"min_lines": F.lit(1), "min_nodes": F.lit(20)}))


def fragment_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.places(spark, folder).where("not whole and signature is not null").select("loc_id", "entry_id", "signature", "start_line", "end_line")
    return fingerprints.ordinals(rows, ["entry_id", "signature"], ["start_line", "end_line", "loc_id"]).select("loc_id", "ordinal")


def run_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return fragments.run_seeds(inputs.document_lines(spark, folder)).select("a", "i", "b", "j").distinct()


def run_islands(spark: SparkSession, folder: str) -> DataFrame:
    return fragments.islands(fragments.run_seeds(inputs.document_lines(spark, folder)))


def run_extended(spark: SparkSession, folder: str) -> DataFrame:
    lines = Workspace(spark, "runs").write(inputs.document_lines(spark, folder), "lines")
    return fragments.extended_runs(fragments.run_seeds(lines), lines)


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    """Matches with their locations' entries, lines and keys."""
    places = inputs.places(spark, folder)
    x = places.select(F.col("loc_id").alias("a"), F.col("entry_id").alias("ea"), F.col("start_line").alias("sa"), F.col("end_line").alias("ta"), F.col("key").alias("ka"), F.col("size").alias("_za"), F.col("whole").alias("_wa"))
    y = places.select(F.col("loc_id").alias("b"), F.col("entry_id").alias("eb"), F.col("start_line").alias("sb"), F.col("end_line").alias("tb"), F.col("key").alias("kb"), F.col("size").alias("_zb"), F.col("whole").alias("_wb"))
    both = inputs.existing(spark, folder).join(x, "a").join(y, "b")
    return both.withColumn("whole", F.col("_wa") & F.col("_wb")).withColumn("size", F.greatest("_za", "_zb")).drop("_za", "_zb", "_wa", "_wb")


def match_pruned(spark: SparkSession, folder: str) -> DataFrame:
    sides = Workspace(spark, "pruned").write(_sides(spark, folder), "sides")
    return fragments.pruned(sides).select("match_id", "a", "b")


def match_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.components(inputs.existing(spark, folder), "a", "b", Workspace(spark, "clusters")).withColumnRenamed("id", "loc_id")


def _clustered(spark: SparkSession, folder: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Locations of clusters with all that findings are told from, and the edges between them."""
    edges = work.write(inputs.existing(spark, folder), "edges")
    members = clusters.components(edges, "a", "b", work).withColumnRenamed("id", "loc_id")
    own = inputs.units(spark, folder).select("entry_id", "kind", "namespace", "identity", "language")
    placed = members.join(inputs.places(spark, folder), "loc_id").join(own, "entry_id", "left")
    placed = placed.withColumn("structural", F.concat_ws("#", "signature", "ordinal"))
    placed = work.write(findings.touched(placed, inputs.changed(spark, folder)), "touched")
    return work.write(findings.aged(placed, inputs.line_ages(spark, folder)), "locations"), edges


def finding_locations(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = _clustered(spark, folder, Workspace(spark, "findings"))
    return placed.select("component", "loc_id", "touched", F.when(F.col("touched"), F.lit(-1.0)).otherwise(F.col("age")).alias("age"))


def finding_ends(spark: SparkSession, folder: str) -> DataFrame:
    return findings.originals(_clustered(spark, folder, Workspace(spark, "findings"))[0])


def finding_payoffs(spark: SparkSession, folder: str) -> DataFrame:
    """What folding each cluster into its original would save, by recorded scores."""
    work = Workspace(spark, "findings")
    placed, edges = _clustered(spark, folder, work)
    return findings.payoffs(placed, findings.end_scores(placed, edges, findings.originals(placed)))


def finding_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return findings.cluster_kinds(_clustered(spark, folder, Workspace(spark, "findings"))[0])


def _base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The older sweep's clusters by key, and by structure."""
    by_key = table(spark, folder, "base_clusters").select(F.concat_ws("|", "repo", "loc_key").alias("key"), F.col("cluster_id").alias("cluster")).distinct()
    shapes = inputs.places(spark, folder).where("signature is not null").select("key", F.concat_ws("#", "signature", "ordinal").alias("structural"))
    return by_key, by_key.join(shapes, "key").select("structural", "cluster").distinct()


def base_labels(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = _clustered(spark, folder, Workspace(spark, "findings"))
    return findings.labels(placed, *_base(spark, folder))


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return base_labels(spark, folder).groupBy("label").agg(F.count("*").alias("n"))


def findings_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Findings in the order of a report: label, payoff, place of the copy."""
    work = Workspace(spark, "findings")
    placed, edges = _clustered(spark, folder, work)
    ends = work.write(findings.originals(placed), "ends")
    copy = placed.select(F.col("loc_id").alias("copy"), "path", "start_line", "end_line", "identity", "language", F.col("size").alias("nodes"), F.col("touched").alias("copy_touched"))
    scores = work.write(findings.end_scores(placed, edges, ends), "scores")
    scored = scores.where("with_copy is not null").select("component", "loc_id", F.col("with_copy").alias("score"))
    top = scored.join(placed.select("loc_id", "path", "start_line", "end_line", "identity", "whole"), "loc_id").groupBy("component").agg(
        F.max("score").alias("score"), F.min_by(F.struct("identity", "whole", "path"), F.struct(-F.col("score"), "path", "start_line", "end_line", "loc_id")).alias("o")
    )
    rows = findings.cluster_kinds(placed).join(ends, "component").join(copy, "copy").join(findings.payoffs(placed, scores), "component", "left").join(findings.labels(placed, *_base(spark, folder)), "component")
    rows = rows.join(top, "component", "left").withColumn("existing", F.col("o.identity")).withColumn("existing_partial", F.coalesce(F.col("o.whole") & paths.base_name(F.col("o.path")).startswith("_"), F.lit(False)))
    rows = rows.withColumn("has_base", F.lit(True)).withColumn("primitive", F.lit(None).cast("string")).withColumn("hint", findings.hints())
    rank = F.array_position(F.array(*map(F.lit, findings.ORDER)), F.col("label"))
    shown = rows.select(rank.alias("rank"), "label", "component", "kind", "members", F.round("score", 6).alias("score"), F.coalesce("payoff", F.lit(0.0)).alias("payoff"), "path", "start_line", "end_line", "identity", "language", "nodes", "copy_touched", "hint")
    return shown.orderBy("rank", F.desc("payoff"), "path", "start_line", "end_line", "identity")


def _key_pairs(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    places = inputs.places(spark, folder).select("loc_id", "key", F.coalesce(F.concat_ws("#", "signature", "ordinal"), F.lit("")).alias("structural"))
    x = places.select(F.col("loc_id").alias("a"), F.col("key").alias("k1"), F.col("structural").alias("s1"))
    y = places.select(F.col("loc_id").alias("b"), F.col("key").alias("k2"), F.col("structural").alias("s2"))
    both = rows.join(x, "a").join(y, "b")
    return both.select(F.least("k1", "k2").alias("ka"), F.greatest("k1", "k2").alias("kb"), F.least("s1", "s2").alias("sa"), F.greatest("s1", "s2").alias("sb"), "score").distinct()


def contracted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that the first revisions of the matches have and the counting ones lost."""
    first = table(spark, folder, "matches").where("rev = 1 and not coalesce(withdrawn, false) and a is not null and b is not null and a <> b")
    first = first.select("a", "b", F.coalesce(inputs.score_value(F.col("score"), F.col("shared_w"), F.col("union_w")), F.lit(0.0)).alias("score"))
    head = _key_pairs(spark, folder, inputs.existing(spark, folder))
    return findings.contracted(_key_pairs(spark, folder, first), head).select("ka", "kb", F.round("score", 6).alias("score"))


def top20_contracted(spark: SparkSession, folder: str) -> DataFrame:
    return contracted_pairs(spark, folder).orderBy("ka", "kb", "score").limit(report.LISTED)


def settings_per_unit(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.units(spark, folder).select("entry_id", "threshold", "min_lines", "min_nodes")


def settings_floors(spark: SparkSession, folder: str) -> DataFrame:
    return contract.floors(inputs.repo_settings(spark, folder))


def _references(spark: SparkSession, folder: str) -> DataFrame:
    """References to units of every kind, made from the units: methods, outer namespaces, globs over both sorts of names."""
    own = inputs.units(spark, folder)
    outer = F.element_at(F.split("namespace", "::"), 1)
    texts = own.where("kind = 'method'").select(F.col("identity").alias("text"))
    texts = texts.union(own.where("namespace is not null").select(outer)).union(own.where("namespace like '%::%'").select(F.concat(outer, F.lit("::*"))))
    texts = texts.union(own.where("kind = 'template'").select(F.concat(F.substring_index("identity", "/", 2), F.lit("/*"))))
    return texts.distinct().select(F.xxhash64("text").alias("ref_id"), "text")


def ref_hits(spark: SparkSession, folder: str) -> DataFrame:
    refs = _references(spark, folder)
    hits = contract.reference_hits(refs, inputs.units(spark, folder))
    return hits.join(refs, "ref_id").select("text", "entry_id")


def most_specific_ref(spark: SparkSession, folder: str) -> DataFrame:
    refs = Workspace(spark, "refs").write(_references(spark, folder), "refs")
    hits = contract.reference_hits(refs, inputs.units(spark, folder))
    return contract.assigned(hits, refs.withColumn("clause_id", F.lit(1))).select("entry_id", "text")


def kept_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches between units that one clause, of all references, names by different references."""
    work = Workspace(spark, "kept")
    refs = work.write(_references(spark, folder), "refs")
    hits = contract.reference_hits(refs, inputs.units(spark, folder))
    own = work.write(contract.assigned(hits, refs.withColumn("clause_id", F.lit(1))), "assigned")
    clauses = spark.createDataFrame([(1, "contract/all/duplication.md", 1)], "clause_id int, path string, line int")
    return contract.kept(_sides(spark, folder), own, clauses).select("match_id")


def unknown_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References in the documents' parallel blocks that name no unit."""
    blocks = documents.block_rows(table(spark, folder, "documents"), "doc_id", "text").where("info = 'parallel'")
    refs = blocks.select(F.explode("lines").alias("text")).distinct().select(F.xxhash64("text").alias("ref_id"), "text")
    refs = Workspace(spark, "refs").write(refs, "refs")
    return contract.unknown_references(refs, contract.reference_hits(refs, inputs.units(spark, folder))).select("text")


def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents.block_rows(table(spark, folder, "documents"), "doc_id", "text")
    return rows.select("doc_id", "block_no", "info", "line", "heading", F.size("lines").alias("lines"))


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = counting_rows(table(spark, folder, "source_files").select("file_id", "file_path", "content", "rev"), "file_id")
    kind = F.coalesce(*(F.when(F.col("file_path").rlike(p), F.lit(k)) for k, p in LANGUAGES.items()))
    return frontends.tree_nodes(rows.withColumn("kind", kind), "file_id", "content", "kind")


def tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Trees of the ERB, JSON and Python files: nodes, depth and distinct digests of each."""
    return _trees(spark, folder).groupBy("entry_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count_distinct("digest").alias("digests"), F.max(F.when(F.col("parent") < 0, F.col("digest"))).alias("root"))


def json_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each JSON file that reads: its trees' nodes (values and members), sequences, and lines."""
    rows = counting_rows(table(spark, folder, "source_files").select("file_id", "file_path", "content", "rev"), "file_id").where(F.col("file_path").rlike(LANGUAGES["json"]))
    nodes = frontends.tree_nodes(rows.withColumn("kind", F.lit("json")), "file_id", "content", "kind")
    return nodes.groupBy(F.col("entry_id").alias("file_id")).agg(F.count("*").alias("nodes"), F.count_if("is_sequence").alias("sequences"), (F.max("end_line") - F.min("start_line") + 1).alias("lines"))


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the Ruby and ERB files, each repository a folder. They are dealt to all cores by path, so that the
    contents are shuffled once for that and for telling paths apart, and nothing runs to count the pieces."""
    rows = counting_rows(table(spark, folder, "source_files").select("file_id", "repo", "file_path", "content", "rev"), "file_id").where("content is not null")
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.select(F.concat_ws("/", "repo", "file_path").alias("path"), F.col("content").cast("binary").alias("content")).repartition(pieces, "path").dropDuplicates(["path"])


def _read_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = _snapshot(spark, folder).select("path", paths.language(F.col("path")).alias("language"), F.col("content").cast("string").alias("text"))
    return units.read_units(rows, "path", "path", "language", "text", trees=False).select(F.col("file_key").alias("path"), "kind", "identity", "start_line", "end_line", "error_line")


def source_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of the Ruby and ERB files, read from their text; an earlier sweep recorded the same ones."""
    return _read_units(spark, folder).where("error_line is null").select("path", "kind", "start_line", "end_line")


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    """The identities of methods and macros that an earlier sweep recorded, read from the files' text. It wrote the names of
    scopes without a colon."""
    found = _read_units(spark, folder).where("kind <> 'template' and error_line is null")
    files = counting_rows(table(spark, folder, "source_files").select("file_id", "repo", "file_path", "rev"), "file_id").select("file_id", F.concat_ws("/", "repo", "file_path").alias("path"))
    known = counting_rows(table(spark, folder, "entries").select("entry_id", "file_id", "unit_kind", "unit_identity", "start_line", "end_line", "rev"), "entry_id").where("unit_identity is not null")
    both = known.join(files, "file_id").withColumnRenamed("unit_kind", "kind").join(found, ["path", "kind", "start_line", "end_line"])
    return both.select("entry_id", F.regexp_replace("identity", r"\(:", "(").alias("identity"))


def source_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Ruby and ERB files that can't be read, and the line of the first error."""
    return _read_units(spark, folder).where("error_line is not null").select("path", "error_line")


def sweep_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of whole units, fragments and runs in the Ruby and ERB files, from their text alone."""
    swept = sweep(spark, _snapshot(spark, folder), documents.Contract(), Workspace(spark, "sweep"))
    keys = swept.locations.select("loc_id", "key")
    both = swept.matches.join(keys.withColumnsRenamed({"loc_id": "a", "key": "ka"}), "a").join(keys.withColumnsRenamed({"loc_id": "b", "key": "kb"}), "b")
    return both.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), "kind", "shared_w", "union_w")


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """The report's rows as JSON objects, in the engine."""
    rows = findings_ranked(spark, folder)
    return rows.select("component", F.to_json(F.struct(F.col("label").alias("class"), "score", "kind", F.struct("path", "start_line", "end_line", "identity", "nodes", F.col("copy_touched").alias("touched")).alias("copy"), "hint", "payoff"), {"ignoreNullFields": "false"}).alias("json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        src_filter, src_flags, generated_files, digest_weights, entry_totals, prefix_digests, unit_sim_pairs, unit_sim_pairs_65, mixed_threshold_pairs, basket_sim_pairs, document_sim_pairs,
        explain_pair, identical_groups, identical_star, bucket_representatives, stand_in_pairs, fragment_groups, fragment_pairs, fragment_links, fragment_ordinals, subtree_pairs, run_seeds, run_islands, run_extended, match_pruned,
        match_clusters, finding_locations, finding_ends, finding_payoffs, finding_kinds, base_labels, label_counts, findings_ranked, contracted_pairs, top20_contracted, settings_per_unit, settings_floors, ref_hits,
        most_specific_ref, kept_matches, unknown_refs, markdown_blocks, tree_nodes, json_nodes, source_units, source_names, source_errors, sweep_matches, report_json,
    )
}
ORACLES: dict[str, str] = oracles.ORACLES
