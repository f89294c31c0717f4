"""Problem 4: all similar pairs between set-valued records, by recursive chosen-path splitting.

After Christiani, Pagh and Sivertsen, "Scalable and robust set similarity join" (2018). Each record is embedded by HASHES
min-wise hash functions. A tree splits its records at every node on one randomly chosen function: records with the same
token of least hash share a child. Nodes of at most ``small`` records are compared by brute force, after filters on set
sizes and on a sketch of one bit per hash function; larger ones are split further. No two splits draw the same function, so
trees miss a pair independently.

The first LEVELS splits draw one function each, so a pair of similarity j gets past them with probability j ** LEVELS.
Nodes that are still large are split on several functions at once, drawn for the node alone: each record goes to as many
children, and a pair is in j times as many of them on average, which is more than one. Such a pair gets to any depth with
a probability that doesn't fall with it (``survival``), while unlike records part. ``trees`` repeats it all until a pair at the
threshold is found with probability ``recall``, whatever the depth. Where a split would not spare SPLIT_COST comparisons a
record, as a node isn't that large or is full of alike records, the node is compared whole, in blocks of BLOCK against BLOCK
spread over tasks. Candidates are verified exactly.

A node's path depends on the record alone, so a level is one shuffle by node, not a pass over the data by the driver. Records
of equal sets are one class until the end, when pairs of classes become pairs of records or numbers of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.digests import effective_sets
from twinspan.llm.distinctive import entry_sets
from twinspan.operators.skew import EASY, HOT, lookup, lookup_by_count
from twinspan.sources.tables import table
from twinspan.work import Workspace

HASHES = 128
#: Splits of a tree on one function each.
LEVELS = 3
#: Records in a block of a node that is compared whole, and members of a class in one piece of a join.
BLOCK, PIECE = 512, 4096
#: What a split costs a record, in comparisons; and the most that its children's comparisons may be of a node's.
SPLIT_COST, SHRINK = 4096, 0.95
SEED = 20180416
#: Standard deviations of the sketch's distance that a pair at the threshold may lie above its mean.
SIGMAS = 6.0


def branches(threshold: float) -> int:
    """Functions that a large node beyond LEVELS is split on: a pair at the threshold meets in 1.6 children or more."""
    return max(2, ceil(1.6 / threshold))


def survival(threshold: float) -> float:
    """The probability that a pair at the threshold meets at every depth beyond LEVELS: the branching process doesn't die."""
    dies, b = 0.0, branches(threshold)
    for _ in range(500):
        dies = (1 - threshold * (1 - dies)) ** b
    return 1 - dies


def tree_count(threshold: float, recall: float) -> int:
    """Trees needed so that a pair at the threshold meets in one of them with probability recall."""
    return max(1, ceil(log(1 - recall) / log(1 - threshold**LEVELS * survival(threshold))))


def sketch_limit(threshold: float) -> int:
    """Bits of the sketch in which pairs at the threshold differ, at most, but for SIGMAS standard deviations."""
    p = (1 - threshold) / 2
    return min(HASHES, ceil(HASHES * p + SIGMAS * (HASHES * p * (1 - p)) ** 0.5))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def embedded(sets: DataFrame, array: str, trees: int, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """Add s0, s1 (the sketch) and drawn (for each tree, the hash that it draws at every level) to rows of non-empty BIGINT
    sets. A node is the tree and the hashes drawn so far."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema) + ", s0 bigint, s1 bigint, drawn array<int>"
    names = [*sets.columns, "s0", "s1", "drawn"]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        functions = max(HASHES, trees * levels)
        factors = rng.integers(0, 2**64, functions, dtype=np.uint64) | np.uint64(1)
        terms = rng.integers(0, 2**64, functions, dtype=np.uint64)
        chosen = rng.permutation(functions)[: trees * levels]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                lists = batch.column(batch.schema.get_field_index(array))
                tokens = _mixed(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                least = np.stack([_mixed(np.minimum.reduceat(tokens * factors[i] + terms[i], starts)) for i in range(functions)])
                bits = (least[:HASHES] & np.uint64(1)) << (np.arange(HASHES, dtype=np.uint64) % np.uint64(64))[:, None]
                halves = [np.bitwise_or.reduce(bits[k : k + 64]).view(np.int64) for k in (0, 64)]
                drawn = (least[chosen] >> np.uint64(32)).astype(np.uint32).view(np.int32).T
                offsets = np.arange(0, batch.num_rows + 1, dtype=np.int32) * (trees * levels)
                columns = [pa.array(h) for h in halves] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(drawn).reshape(-1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return sets.mapInArrow(embed, schema)


def _alike(limit: int, num: int, den: int) -> Column:
    """Sizes and sketches of rows a and b allow a similarity of num / den."""
    bits = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    fits = F.least("a.n", "b.n") * F.lit(den) >= F.greatest("a.n", "b.n") * F.lit(num)
    return (F.col("a.c") < F.col("b.c")) & fits & (bits <= limit)


def similar_classes(classes: DataFrame, work: Workspace, num: int, den: int, recall: float = 0.9999, small: int = 64) -> DataFrame:
    """(c, d): pairs, c < d, of classes whose sets' shared part is at least num / den of their union.

    classes: (c BIGINT unique, digests ARRAY<BIGINT> distinct and not empty). The pairs found are right; each is found with
    the probability the module's text states.
    """
    threshold = num / den
    trees, limit = tree_count(threshold, recall), sketch_limit(threshold)
    rows = work.write(embedded(classes.select("c", "digests"), "digests", trees).withColumn("n", F.size("digests")), "embedded")
    active = rows.select("c", "n", "s0", "s1", F.posexplode(F.expr(f"transform(sequence(0, {trees - 1}), t -> slice(drawn, t * {LEVELS} + 1, {LEVELS}))")).alias("t", "path"))
    active = active.select("c", "n", "s0", "s1", "t", "path", F.expr("xxhash64(t, path[0])").alias("node"))
    found: list[DataFrame] = []
    for level in range(LEVELS):
        large = work.write(active.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > small), "large")
        little, rest = _by_size(active, large)
        found.append(work.write(_pairs(little, limit, num, den), "pairs"))
        if rest is None:
            break
        if level < LEVELS - 1:
            active = work.write(rest.select("c", "n", "s0", "s1", "t", "path", F.expr(f"xxhash64(t, slice(path, 1, {level + 2}))").alias("node")), "active")
        else:
            found += _deeper(rest, classes, work, limit, num, den, small)
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    return verified(pairs.distinct(), classes, num, den)


def _by_size(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows in nodes that aren't large, and those in large ones with the node's count m; None if there are none. Rows of
    hot nodes stay where they are."""
    total, most = large.agg(F.sum("m"), F.max("m")).first()
    if total is None:
        return rows, None
    if most <= max(total // HOT, EASY):
        return rows.join(large.select("node"), "node", "left_anti"), rows.join(large, "node")
    hot = F.broadcast(large.where(F.col("m") > max(total // HOT, EASY)))
    cold = rows.join(hot.select("node"), "node", "left_anti")
    return cold.join(large.select("node"), "node", "left_anti"), rows.join(hot, "node").unionByName(cold.join(large, "node"))


def _pairs(rows: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """(c, d): candidate pairs within small nodes."""
    node = rows.select("node", "c", "n", "s0", "s1")
    pairs = node.alias("a").join(node.alias("b"), (F.col("a.node") == F.col("b.node")) & _alike(limit, num, den))
    return pairs.select(F.col("a.c").alias("c"), F.col("b.c").alias("d")).distinct()


def _deeper(rest: DataFrame, classes: DataFrame, work: Workspace, limit: int, num: int, den: int, small: int) -> list[DataFrame]:
    """Candidate pairs (c, d) of nodes that are still large: split on several functions of their own, or compared whole.

    Every split node's children take less than SHRINK of its own comparisons, so levels end.
    """
    rest = work.write(rest.select("node", "m", "c", "n", "s0", "s1"), "deep")
    worth = F.col("m") * SHRINK > SPLIT_COST  # else no split can pay
    found = [work.write(_blocks(rest.where(~worth), limit, num, den).distinct(), "pairs")]
    rest = rest.where(worth)
    if rest.isEmpty():
        return found
    b = branches(num / den)
    active = work.write(lookup(rest, classes.select("c", "digests"), "c"), "deep")
    while True:
        kid = F.expr(f"explode(transform(sequence(1, {b}), k -> xxhash64(node, k, array_min(transform(digests, x -> xxhash64(x, node, k))))))").alias("kid")
        split = work.write(active.select("*", kid), "split")
        sizes = work.write(split.groupBy("node", "kid").agg(F.count("*").alias("k"), F.first("m").alias("m")), "sizes")
        square, m = F.col("k").cast("double") * F.col("k"), F.first("m").cast("double")
        judged = work.write(sizes.groupBy("node").agg((F.sum(square) + SPLIT_COST * m < SHRINK * m * m).alias("split")), "judged")
        whole = lookup(active.select("node", "m", "c", "n", "s0", "s1"), judged.where("not split").select("node"), "node")
        found.append(work.write(_blocks(whole, limit, num, den).distinct(), "pairs"))
        kids = lookup(split.drop("m"), judged.where("split").select("node"), "node").drop("node").withColumnRenamed("kid", "node")
        large = lookup(sizes, judged.where("split").select("node"), "node").where(F.col("k") > small)
        little, rest = _by_size(kids, work.write(large.select(F.col("kid").alias("node"), F.col("k").alias("m")), "large"))
        found.append(work.write(_pairs(little, limit, num, den), "pairs"))
        if rest is None:
            return found
        after = work.write(rest.select("node", "m", "c", "n", "s0", "s1", "digests"), "deep")
        work.drop(active, split)
        active = after


def _blocks(rest: DataFrame, limit: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Candidate pairs of nodes of any size m: every block of about ``block`` records meets every other in a task of its own."""
    k = F.greatest(F.ceil(F.col("m") / F.lit(block)).cast("int"), F.lit(1))
    cut = rest.select("node", "c", "n", "s0", "s1", k.alias("k"), F.pmod(F.xxhash64("c"), k).cast("int").alias("own"))
    left = cut.select("*", F.explode(F.sequence(F.col("own"), F.col("k") - 1)).alias("other"))
    right = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("other"))
    met = (F.col("a.node") == F.col("b.node")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    swapped = _alike(limit, num, den) | _alike_swapped(limit, num, den)
    pairs = left.alias("a").join(right.alias("b"), met & swapped)
    return pairs.select(F.least("a.c", "b.c").alias("c"), F.greatest("a.c", "b.c").alias("d"))


def _alike_swapped(limit: int, num: int, den: int) -> Column:
    bits = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    fits = F.least("a.n", "b.n") * F.lit(den) >= F.greatest("a.n", "b.n") * F.lit(num)
    return (F.col("a.c") > F.col("b.c")) & (F.col("a.own") < F.col("b.own")) & fits & (bits <= limit)


def verified(candidates: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs (c, d) of classes (c, digests) whose sets have a similarity of at least num / den."""
    left = classes.select("c", F.col("digests").alias("x"))
    right = classes.select(F.col("c").alias("d"), F.col("digests").alias("y"))
    both = candidates.join(left, "c").join(right, "d")
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    united = F.size("x") + F.size("y") - shared
    return both.where(shared * F.lit(den) >= united * F.lit(num)).select("c", "d")


def classes_of(records: DataFrame, key: str, array: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Records of equal sets made one class: (c, digests, size), and (c, then the records' columns but the array) for all.

    c is the least key of the class and size how many records it has. Sets are told apart by 128 bits of hashes of their
    sorted arrays.
    """
    digests = F.array_sort(array)
    hashes = F.struct(F.xxhash64(digests), F.xxhash64(F.lit(1), F.reverse(digests))).alias("_set")
    kept = work.write(records.select(*records.columns, hashes), "records")
    classes = work.write(kept.groupBy("_set").agg(F.min(key).alias("c"), F.count("*").alias("_n"), F.first(array).alias("digests")), "classes")
    total = classes.agg(F.sum("_n")).first()[0] or 0
    members = lookup_by_count(kept.drop(array), classes.select("_set", "_n", "c"), "_set", "_n", total).drop("_set", "_n")
    return classes.select("c", "digests", F.col("_n").alias("size")), work.write(members, "members")


def similar_groups(records: DataFrame, key: str, owner: str, array: str, work: Workspace, num: int, den: int, least: int = 1, recall: float = 0.9999, repeated: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, pairs): classes of records with equal sets, (c, digests, size); the records, (c, id, own); and all
    pairs (c, d), c < d, of classes whose sets' similarity is num / den or more. No record is paired with its copies.

    Sets hold distinct non-null BIGINTs; records with a null set, or one smaller than ``least``, take no part. Equality
    meets the threshold. Repeated rows of a record count once (repeated=False spares the shuffle where there are none);
    extra columns are ignored.
    """
    rows = records.where(F.size(array) >= max(least, 1)).select(F.col(key).alias("id"), F.col(owner).alias("own"), array)
    classes, members = classes_of(rows.dropDuplicates(["id", "own"]) if repeated else rows, "id", array, work)
    return classes, members, work.write(similar_classes(classes, work, num, den, recall), "class_pairs")


def similar_pairs(records: DataFrame, key: str, owner: str, array: str, work: Workspace, num: int, den: int, least: int = 1, recall: float = 0.9999, repeated: bool = True) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records with different owners whose sets' similarity is num / den or more.

    The pairs of ``similar_groups`` written out for every record; a class of many records meets others piece by piece, so no
    task has all its pairs.
    """
    classes, members, pairs = similar_groups(records, key, owner, array, work, num, den, least, recall, repeated)
    pieces = F.ceil(F.col("size") / F.lit(PIECE)).cast("int")
    sizes = classes.select("c", pieces.alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")
    cut = work.write(lookup(members, sizes, "c").select("c", "id", "own", piece), "cut")
    every = pairs.unionByName(classes.where("size > 1").select("c", F.col("c").alias("d")))
    spread = lambda rows, x, p: lookup(rows, sizes.withColumnsRenamed({"c": x}), x).select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias(p))
    every = spread(spread(every, "c", "p"), "d", "q")
    left = cut.select("c", F.col("piece").alias("p"), F.col("id").alias("a"), F.col("own").alias("oa"))
    right = cut.select(F.col("c").alias("d"), F.col("piece").alias("q"), F.col("id").alias("b"), F.col("own").alias("ob"))
    met = every.join(left, ["c", "p"]).join(right, ["d", "q"]).where("(c <> d or a < b) and not oa <=> ob")
    return met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def link_counts(records: DataFrame, key: str, owner: str, array: str, work: Workspace, num: int, den: int, least: int = 1, recall: float = 0.9999, repeated: bool = True) -> DataFrame:
    """(id, class_id, links): each record's class of equal sets, by its least record, and how many records of other owners
    ``similar_pairs`` would pair it with, counted by classes and owners without writing a pair."""
    classes, members, pairs = similar_groups(records, key, owner, array, work, num, den, least, recall, repeated)
    sizes = classes.select("c", "size")
    both = pairs.unionByName(pairs.select(F.col("d").alias("c"), F.col("c").alias("d"))).unionByName(classes.select("c", F.col("c").alias("d")))
    reached = lookup(both, sizes.withColumnsRenamed({"c": "d"}), "d").groupBy("c").agg(F.sum("size").alias("near"))
    # records of one owner pair with none of their own: those are taken off, for owners with records in several classes
    owned = work.write(members.groupBy("c", "own").agg(F.count("*").alias("k")), "owned")
    several = owned.where("own is not null").groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select("own")
    across = work.write(lookup(owned, several, "own"), "across")
    own = pairs.unionByName(pairs.select(F.col("d").alias("c"), F.col("c").alias("d"))).join(across.select("c", "own"), "c")
    own = own.join(across.select(F.col("c").alias("d"), "own", "k"), ["d", "own"]).groupBy("c", "own").agg(F.sum("k").alias("k"))
    off = owned.unionByName(own).groupBy("c", "own").agg(F.sum("k").alias("off")).where("own is not null")
    told = lookup(members, reached, "c").alias("m").join(off.alias("o"), (F.col("m.c") == F.col("o.c")) & (F.col("m.own") == F.col("o.own")), "left")
    # a record without an owner is of the same owner as others without
    none = owned.where("own is null").select("c", F.col("k").alias("none"))
    every = lookup(both.select("c", "d"), none.withColumnsRenamed({"c": "d"}), "d").groupBy("c").agg(F.sum("none").alias("none"))
    told = told.select("m.c", "m.id", "m.own", "near", "off").join(every, "c", "left")
    taken = F.when(F.col("own").isNull(), F.coalesce("none", F.lit(0))).otherwise(F.coalesce("off", F.lit(0)))
    return told.select("id", F.col("c").alias("class_id"), (F.col("near") - taken).alias("links"))


def location_sets(spark, sf_dir: str) -> DataFrame:
    """(loc_id, entry_id, digests) of the locations with a set; repeated rows of a location once."""
    locations = table(spark, sf_dir, "locations").where("fp_set is not null and loc_id is not null").select("loc_id", "entry_id", "fp_set")
    return effective_sets(locations, "fp_set").dropDuplicates(["loc_id"])


def _records(spark, sf_dir: str) -> DataFrame:
    """(id, own, digests) of all entries and locations with a set."""
    entries = entry_sets(spark, sf_dir).select(F.col("entry_id").alias("id"), F.col("entry_id").alias("own"), "digests")
    locations = location_sets(spark, sf_dir).select(F.col("loc_id").alias("id"), F.col("entry_id").alias("own"), "digests")
    return entries.unionByName(locations)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of entries and locations of different entries with a similarity of 0.80 or more."""
    return similar_pairs(_records(spark, sf_dir), "id", "own", "digests", Workspace(spark, "p4"), 4, 5, least=5, repeated=False)


def p4_links(spark, sf_dir: str) -> DataFrame:
    """Of each entry and location the class of equal sets and the number of its pairs, none of them written out."""
    return link_counts(_records(spark, sf_dir), "id", "own", "digests", Workspace(spark, "p4"), 4, 5, least=5, repeated=False)
