"""Copied fragments and statement runs: equality joins on digests, and their gapped extension.

Locations: (loc_id, entry_id, path, start_line, end_line, size, signature, ...). Sequences: (seq_id, digests), the digests
of a run of sibling statements, and where known (starts, ends), the statements' first and last lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.operators.skew import lookup
from twinspan.work import Workspace

#: Up to so many occurrences give all pairs, more a star.
FRAGMENT_CAP, SEED_CAP = 100, 50


def fragment_pairs(locations: DataFrame, cap: int = FRAGMENT_CAP) -> DataFrame:
    """(signature, a, b), a < b: locations of equal signature that don't overlap; where more than cap occur, stars that
    connect what those pairs would. Locations may have floors (min_lines, min_nodes, and size); without, every place fits.
    Groups over the cap are linear and need no group in one task."""
    floors = ["size", "min_lines", "min_nodes"] if {"min_lines", "min_nodes"} <= set(locations.columns) else []
    known = locations.where("signature is not null").select("signature", "loc_id", "path", "start_line", "end_line", *floors)
    counts = known.groupBy("signature").agg(F.count("*").alias("n")).where("n >= 2")
    small = known.join(counts.where(F.col("n") <= cap).select("signature"), "signature")
    x, y = small.alias("x"), small.alias("y")
    clash = (F.col("x.path") == F.col("y.path")) & (F.col("x.start_line") <= F.col("y.end_line")) & (F.col("y.start_line") <= F.col("x.end_line"))
    every = x.join(y, (F.col("x.signature") == F.col("y.signature")) & (F.col("x.loc_id") < F.col("y.loc_id")) & ~clash)
    every = every.select("x.signature", F.col("x.loc_id").alias("a"), F.col("y.loc_id").alias("b"))
    large = lookup(known, counts.where(F.col("n") > cap).select("signature"), "signature")
    if not floors:
        large = large.withColumns({"size": F.lit(1), "min_lines": F.lit(0), "min_nodes": F.lit(0)})
    return every.unionByName(class_stars(large))


def class_stars(locations: DataFrame) -> DataFrame:
    """(signature, a, b), a < b: per group and pair of settings classes, each location that meets the pair's floors joined
    to a hub of the other class that does and that it doesn't overlap, wherever there is one.

    Locations also have size, min_lines and min_nodes. The hub is a class's first; for locations that overlap it the first
    in another file; where all are in one file, the one that ends first or the one that starts last. A group's settings
    classes are few, its locations may be any number: they are looked at one by one.
    """
    clash = lambda h: (F.col("path") == F.col(f"{h}.path")) & (F.col("start_line") <= F.col(f"{h}.end_line")) & (F.col(f"{h}.start_line") <= F.col("end_line"))
    work = Workspace(locations.sparkSession, "stars")
    own = F.struct("min_lines", "min_nodes").alias("own")
    cut = work.write(locations.select("signature", "loc_id", "path", "start_line", "end_line", "size", own), "cut")
    classes = cut.groupBy("signature", "own").agg(F.count("*").alias("n")).groupBy("signature").agg(F.collect_list("own").alias("others"), F.sum("n").alias("n")).where("n >= 2")
    met = lookup(cut, classes.select("signature", "others"), "signature").withColumn("other", F.explode("others"))
    lines = F.col("end_line") - F.col("start_line") + 1
    met = met.where((lines >= F.least("own.min_lines", "other.min_lines")) & (F.col("size") >= F.least("own.min_nodes", "other.min_nodes")))
    met = work.write(met.select("signature", "own", "other", "loc_id", "path", "start_line", "end_line", F.struct("loc_id", "path", "start_line", "end_line").alias("m")), "met")
    group = ["signature", "own", "other"]
    # of each file first, so that a group's rows are few when they meet
    of_file = met.groupBy(*group, "path").agg(F.min("m").alias("m"), F.min_by("m", F.struct("end_line", "loc_id")).alias("lo"), F.max_by("m", F.struct("start_line", "loc_id")).alias("hi"))
    of_file = work.write(of_file, "of_file")
    firsts = of_file.groupBy(*group).agg(F.min("m").alias("h1"))
    hubs = lookup(of_file, firsts, group).groupBy(*group, "h1").agg(
        F.min(F.when(F.col("path") != F.col("h1.path"), F.col("m"))).alias("h2"), F.min_by("lo", F.struct("lo.end_line", "lo.loc_id")).alias("lo"), F.max_by("hi", F.struct("hi.start_line", "hi.loc_id")).alias("hi")
    )
    facing = hubs.select("signature", F.col("own").alias("other"), F.col("other").alias("own"), "h1", "h2", "lo", "hi")
    hub = F.when(~clash("h1"), F.col("h1")).when(F.col("h2").isNotNull(), F.col("h2")).when(~clash("lo"), F.col("lo")).when(~clash("hi"), F.col("hi"))
    edges = lookup(met, facing, group).select("signature", "loc_id", hub["loc_id"].alias("h")).where("h is not null")
    return edges.select("signature", F.least("h", "loc_id").alias("a"), F.greatest("h", "loc_id").alias("b")).distinct()


def run_seeds(sequences: DataFrame, cap: int = SEED_CAP) -> DataFrame:
    """(gram, a, i, b, j): places of equal three digests, (a, i) before (b, j); where more than cap occur, those with the
    one that spans most lines, as one squeezed onto few fails the floor of lines with all others; of equals, and where
    sequences have no lines, the first."""
    known = {"starts", "ends"} <= set(sequences.columns)
    grams = sequences.select("seq_id", *(["starts", "ends"] if known else []), F.expr("explode(transform(if(size(digests) >= 3, sequence(0, size(digests) - 3), array()), i -> struct(cast(i as int) as at, array_join(slice(digests, cast(i as int) + 1, 3), ' ') as gram)))").alias("g"))
    reach = F.expr("ends[g.at + 2] - starts[g.at]") if known else F.lit(0)
    grams = grams.select("seq_id", reach.alias("reach"), F.col("g.at").alias("at"), F.col("g.gram").alias("gram"))
    place = F.struct((-F.col("reach")).alias("l"), "seq_id", "at")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min(place).alias("hub")).where("n >= 2")
    small = grams.join(counts.where(F.col("n") <= cap).select("gram"), "gram")
    x, y = small.alias("x"), small.alias("y")
    before = (F.col("x.seq_id") < F.col("y.seq_id")) | (F.col("x.seq_id") == F.col("y.seq_id")) & (F.col("x.at") < F.col("y.at"))
    every = x.join(y, (F.col("x.gram") == F.col("y.gram")) & before).select("x.gram", F.col("x.seq_id").alias("a"), F.col("x.at").alias("i"), F.col("y.seq_id").alias("b"), F.col("y.at").alias("j"))
    large = grams.join(counts.where(F.col("n") > cap).select("gram", "hub"), "gram").where("seq_id <> hub.seq_id or at <> hub.at")
    first = (F.col("hub.seq_id") < F.col("seq_id")) | (F.col("hub.seq_id") == F.col("seq_id")) & (F.col("hub.at") < F.col("at"))
    pick = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    star = large.select("gram", pick("hub.seq_id", "seq_id").alias("a"), pick("hub.at", "at").alias("i"), pick("seq_id", "hub.seq_id").alias("b"), pick("at", "hub.at").alias("j"))
    return every.unionByName(star)


def islands(seeds: DataFrame) -> DataFrame:
    """(a, b, diagonal, first, last): unbroken stretches of equal statements of three or more, in a's positions; diagonal is
    i - j. Gaps and islands over the seeds of each diagonal."""
    points = seeds.select("a", "b", (F.col("i") - F.col("j")).alias("diagonal"), F.col("i")).distinct()
    w = Window.partitionBy("a", "b", "diagonal").orderBy("i")
    marked = points.withColumn("island", F.col("i") - F.row_number().over(w))
    # seeds one or two apart overlap in statements, so their stretches are one only when every seed between is there
    return marked.groupBy("a", "b", "diagonal", "island").agg(F.min("i").alias("first"), (F.max("i") + 2).alias("last")).drop("island")


def extended_runs(seeds: DataFrame, sequences: DataFrame) -> DataFrame:
    """(a, b, diagonal, core_first, core_last, first, last): each stretch of three or more equal statements, grown over
    one differing statement: forward, or, where nothing follows it, backward. Stretches of one or two statements count as
    something to grow into, so equality is looked up in the sequences. Runs of a sequence with itself that overlap are
    left out."""
    cores = islands(seeds)
    x = sequences.select(F.col("seq_id").alias("a"), F.col("digests").alias("da"))
    y = sequences.select(F.col("seq_id").alias("b"), F.col("digests").alias("db"))
    both = cores.join(x, "a").join(y, "b")
    same = "(x -> x >= 0 and x < size(da) and x - diagonal >= 0 and x - diagonal < size(db) and da[x] = db[x - diagonal])"
    ahead = F.expr(f"if(exists(array(last + 2), {same[1:-1]}), aggregate(sequence(last + 2, greatest(last + 2, size(da) - 1)), struct(last + 2 as e, true as go), (s, x) -> if(s.go and x - diagonal >= 0 and x - diagonal < size(db) and x < size(da) and da[x] = db[x - diagonal], struct(x as e, true as go), struct(s.e as e, false as go))).e, last)")
    grown = both.withColumn("_ahead", ahead.cast("int"))
    back = F.expr(f"if(_ahead > last, first, if(exists(array(first - 2), {same[1:-1]}), aggregate(sequence(first - 2, 0, -1), struct(first - 2 as e, true as go), (s, x) -> if(s.go and x - diagonal >= 0 and x - diagonal < size(db) and da[x] = db[x - diagonal], struct(x as e, true as go), struct(s.e as e, false as go))).e, first))")
    runs = grown.select("a", "b", "diagonal", F.col("first").alias("core_first"), F.col("last").alias("core_last"), back.cast("int").alias("first"), F.col("_ahead").alias("last"))
    return runs.where((F.col("a") != F.col("b")) | (F.abs("diagonal") > F.col("last") - F.col("first")))


def pruned(matches: DataFrame) -> DataFrame:
    """Matches without those inside an earlier one of the same pair of entries, on both sides.

    matches: (match_id, ea, sa, ta, eb, sb, tb, whole, size, ka, kb): entries, first and last lines, whether both sides are
    whole units, sizes and keys. Earlier: whole first, then larger, then by keys and id.
    """
    order = ["ea", "eb"]
    swap = F.col("ea") > F.col("eb")
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    flat = matches.select("match_id", "whole", "size", side("ea", "eb").alias("ea"), side("sa", "sb").alias("sa"), side("ta", "tb").alias("ta"), side("eb", "ea").alias("eb"), side("sb", "sa").alias("sb"), side("tb", "ta").alias("tb"), F.least("ka", "kb").alias("k1"), F.greatest("ka", "kb").alias("k2"))
    rank = F.struct((~F.col("whole")).alias("w"), (-F.col("size")).alias("s"), "k1", "k2", "match_id")
    flat = flat.select(*order, "match_id", "sa", "ta", "sb", "tb", rank.alias("rank"))
    x, y = flat.alias("x"), flat.alias("y")
    inside = lambda s, t, u, v: (F.col(f"x.{s}") >= F.col(f"y.{u}")) & (F.col(f"x.{t}") <= F.col(f"y.{v}"))
    straight = inside("sa", "ta", "sa", "ta") & inside("sb", "tb", "sb", "tb")
    crossed = (F.col("x.ea") == F.col("x.eb")) & inside("sa", "ta", "sb", "tb") & inside("sb", "tb", "sa", "ta")
    earlier = (F.col("x.ea") == F.col("y.ea")) & (F.col("x.eb") == F.col("y.eb")) & (F.col("y.rank") < F.col("x.rank"))
    kept = x.join(y, earlier & (straight | crossed), "left_anti").select("match_id")
    return matches.join(kept, "match_id", "left_semi")


def without_twins(matches: DataFrame, twins: DataFrame) -> DataFrame:
    """Fragment matches but those between entries that are identical as wholes; twins: (entry_id, group)."""
    x = twins.select(F.col("entry_id").alias("ea"), F.col("group").alias("_ga"))
    y = twins.select(F.col("entry_id").alias("eb"), F.col("group").alias("_gb"))
    both = matches.join(x, "ea", "left").join(y, "eb", "left")
    return both.where("whole or not coalesce(_ga = _gb, false)").drop("_ga", "_gb")
