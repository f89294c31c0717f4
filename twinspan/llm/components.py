"""Problem 3: consolidating pairwise matches into groups.

Deterministic Boruvka hooking. Edges are ordered by (smaller end, larger end), so the smallest outgoing edge of a
component is the one to its smallest neighbour. Every component hooks onto that neighbour; of two that choose each other
the smaller becomes a root. Pointer doubling collapses the trees, edges are relabelled and deduplicated, and rounds go on
until no edge is left. A round at least halves the components that still have edges.

The graph stays distributed. Each round's map of components to roots is a written table; at the end the maps are composed
from the last to the first, so the work over all rounds is proportional to the edges. Rows of a map whose parent is
already a root take no part in later doubling steps. Hot vertices, as the hub of a star, are pre-aggregated where they are
grouped, and where they are looked up their rows stay where they are (``skew.lookup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.skew import EASY, lookup, lookup_by_count
from twinspan.sources.tables import table
from twinspan.work import Workspace


def connected_groups(edges: DataFrame, a: str, b: str, work: Workspace) -> DataFrame:
    """(id, group_id): every id of an edge between two different ids, with the smallest id reachable from it.

    Edges may be repeated, reversed, loops or half null; the last two link nothing. Ids are BIGINTs.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    left = work.write(pairs.select(lo, hi).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        roots = _collapsed(_hooked(left, work), work)
        maps.append(roots)
        r1 = roots.select(F.col("v").alias("lo"), F.col("p").alias("p_lo"))
        r2 = roots.select(F.col("v").alias("hi"), F.col("p").alias("p_hi"))
        once = lookup(left, r1, "lo")
        if left.count() > EASY:  # else no key is hot
            once = work.write(once, "once")
        moved = lookup(once, r2, "hi").where("p_lo <> p_hi")
        after = work.write(moved.select(F.least("p_lo", "p_hi").alias("lo"), F.greatest("p_lo", "p_hi").alias("hi")).distinct(), "edges")
        work.drop(left)
        left = after
    if not maps:
        return left.select(F.col("lo").alias("id"), F.col("hi").alias("group_id"))
    final = maps.pop()
    while maps:
        later = final.select(F.col("v").alias("p"), F.col("p").alias("q"))
        own = maps.pop()
        after = work.write(lookup(own, later, "p", how="left").select("v", F.coalesce("q", "p").alias("p")), "map")
        work.drop(final, own)
        final = after
    least = final.groupBy("p").agg(F.min("v").alias("group_id"))
    return lookup(final, least, "p").select(F.col("v").alias("id"), "group_id")


def _hooked(edges: DataFrame, work: Workspace) -> DataFrame:
    """(v, p): every component's parent; a root is its own."""
    both = edges.select(F.col("lo").alias("v"), F.col("hi").alias("w")).union(edges.select("hi", "lo"))
    pick = work.write(both.groupBy("v").agg(F.min("w").alias("p")), "pick")
    of_parent = pick.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    looked = lookup(pick, of_parent, "p")
    root = (F.col("pp") == F.col("v")) & (F.col("v") < F.col("p"))
    parent = looked.select("v", F.when(root, F.col("v")).otherwise(F.col("p")).alias("p"))
    hooked = work.write(parent, "hook")
    work.drop(pick)
    return hooked


def _collapsed(hooked: DataFrame, work: Workspace) -> DataFrame:
    """(v, p) with every p a root, by pointer doubling."""
    finished = hooked.where("v = p")
    parts = [finished]
    open_rows, pointers = hooked.where("v <> p"), hooked
    while True:
        step = lookup(open_rows, pointers.select(F.col("v").alias("p"), F.col("p").alias("q")), "p")
        step = work.write(step.select("v", F.col("q").alias("p"), (F.col("p") == F.col("q")).alias("done")), "double")
        parts.append(step.where("done").select("v", "p"))
        open_rows = step.where("not done").select("v", "p")
        if open_rows.isEmpty():
            break
        pointers = _union([*parts, open_rows])
    return work.write(_union(parts), "roots")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def existing_matches(spark, sf_dir: str, *columns: str) -> DataFrame:
    """The given columns of the matches whose counting row isn't withdrawn."""
    matches = table(spark, sf_dir, "matches").where("match_id is not null")
    rev = F.coalesce("rev", F.lit(-(2**31)))
    latest = matches.groupBy("match_id").agg(*(F.max_by(c, rev).alias(c) for c in dict.fromkeys((*columns, "withdrawn"))))
    return latest.where("not coalesce(withdrawn, false)").select(*columns)


def cluster_links(spark, sf_dir: str, work: Workspace) -> DataFrame:
    """(a, b): the locations of each older cluster, every one linked to the smallest."""
    clusters = table(spark, sf_dir, "base_clusters").where("cluster_id is not null")
    locations = table(spark, sf_dir, "locations").select("repo", "loc_key", "loc_id").where("loc_id is not null")
    members = work.write(locations.join(clusters, ["repo", "loc_key"]).select("cluster_id", "loc_id").distinct(), "members")
    hubs = work.write(members.groupBy("cluster_id").agg(F.min("loc_id").alias("hub"), F.count("*").alias("n")), "hubs")
    total = hubs.agg(F.sum("n")).first()[0] or 0
    return lookup_by_count(members, hubs, "cluster_id", "n", total).select(F.col("loc_id").alias("a"), F.col("hub").alias("b"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Every location in a group of two or more, with the smallest loc_id of its group."""
    work = Workspace(spark, "p3")
    links = existing_matches(spark, sf_dir, "a", "b").unionByName(cluster_links(spark, sf_dir, work))
    return connected_groups(links, "a", "b", work).withColumnRenamed("id", "loc_id")
