"""Problem 5: near-duplicate records with small edits, by the generalised pigeonhole principle.

After Qin et al., "GPH: Similarity search in Hamming space" (2018). A record's set is a bit vector in which each token sets
the bit it hashes to; tokens held by more than one in COMMON records have bits of their own. Bits that occur together are
put next to each other and the line is cut into partitions. Two sets of similarity j differ in at most
(1 - j) / (1 + j) * (their sizes together) tokens, t. If thresholds T of the partitions satisfy sum(T + 1) = t + 1, then in
some partition the two differ in at most T tokens. A record (the larger of a pair) spends t + 1 over its partitions as
T = -1 (not probed), 0 (same tokens there) or 1 (one token more or less), by dynamic programming on how many candidates each
choice brings, counted in the index of all records. Probes meet the index, and candidates are verified exactly, so no pair is
missed and none is wrong. Sizes are served by lines cut into twice, four times ... as many partitions, without an end.

A line of more than BLOCK partitions is planned in blocks of as many: the units of t + 1 go to the blocks in which they cost
least, and the dynamic program runs within each block, so time and memory are in proportion to a record's size. Empty
partitions are never probed, as nearly all records share them. The few records whose filled partitions can't take t + 1 (all
tokens on one bit, say) find their candidates by the tokens they hold instead: a partner holds one of their rarest ones.

Links between classes of equal sets, their members and recorded matches are then grouped by the operator of problem 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.digests import effective_sets
from twinspan.llm.components import connected_groups, existing_matches
from twinspan.llm.setjoin import classes_of, verified
from twinspan.operators.skew import lookup_by_count
from twinspan.sources.tables import counting_rows, table
from twinspan.work import Workspace

#: Bits of a vector, those of them for common tokens, and places on the line within one bit.
BITS, COMMON_BITS, FINE = 192, 48, 1 << 20
#: A token is common when more than one in COMMON records holds it, and of those the MOST_COMMON that most hold. Only which
#: bit a token sets depends on it.
COMMON, MOST_COMMON = 100, 1 << 16
#: Partitions of the smallest records' line, and of a block that is planned as a whole.
PARTS, BLOCK = 24, 768
#: Bytes of back pointers of one dynamic program, tokens taken in one step, and index rows of one piece of a key.
PLAN_BYTES, STEP_TOKENS, PIECE = 32 << 20, 1 << 20, 4096
#: A cost that is never paid.
FAR = 1 << 50


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def difference(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens in which a set of n tokens and one not larger differ at most when they are num / den similar."""
    return (2 * n * (den - num)) // (den + num)


def levels_of(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The level, 0, 1, ... of the line with enough partitions for sets of n tokens."""
    need = difference(n, num, den) + 1
    return np.ceil(np.log2(np.maximum(need / PARTS, 1))).astype(np.int64)


class Line:
    """Places of tokens on the line of bits."""

    def __init__(self, common: np.ndarray, rank: np.ndarray):
        self.common, self.rank = np.sort(common), rank

    def bits(self, tokens: np.ndarray) -> np.ndarray:
        mixed = _mixed(tokens)
        rare = COMMON_BITS + (mixed >> np.uint64(20)) % np.uint64(BITS - COMMON_BITS)
        often = (mixed >> np.uint64(20)) % np.uint64(COMMON_BITS)
        return np.where(np.isin(tokens, self.common), often, rare).astype(np.int64)

    def parts(self, tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The partition of each token on lines of count partitions."""
        place = self.rank[self.bits(tokens)] * FINE + (_mixed(tokens + np.uint64(7)) % np.uint64(FINE)).astype(np.int64)
        return place * count // (BITS * FINE)


def _key(level: np.ndarray, part: np.ndarray, total: np.ndarray) -> np.ndarray:
    return _mixed(_mixed((level * 2**32 + part).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + total)


def _flat(batch: pa.RecordBatch, array: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(array))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes


def _steps(batches: Iterator[pa.RecordBatch], array: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most 8192, and of about STEP_TOKENS tokens."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(array)).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.maximum(np.cumsum(sizes) // STEP_TOKENS, 0) + np.arange(len(sizes)) // 8192 * (1 << 40)
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for at, end in zip(begins, [*begins[1:], len(group)], strict=False):
            yield batch.slice(at, end - at)


def co_occurrence(classes: DataFrame, line: Line) -> np.ndarray:
    """How many records set both of two bits, over all records: BITS x BITS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((BITS, BITS))
        for batch in _steps(batches, "digests"):
            tokens, sizes = _flat(batch, "digests")
            vectors = np.zeros((batch.num_rows, BITS), dtype=np.float32)
            vectors[np.repeat(np.arange(batch.num_rows), sizes), line.bits(tokens)] = 1
            whole += vectors.T @ vectors
        cells = whole[np.triu_indices(BITS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells.astype(np.int64))], names=["cell", "n"])

    sums = classes.select("digests").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((BITS, BITS))
    rows, columns = np.triu_indices(BITS)
    out[rows[sums["cell"]], columns[sums["cell"]]] = sums["n"]
    return np.maximum(out, out.T)


def chained(together: np.ndarray, records: int) -> np.ndarray:
    """The rank of each bit in a chain in which every bit is followed by the free bit most correlated with it."""
    p = np.diag(together) / max(records, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = (together / max(records, 1) - np.outer(p, p)) / np.outer(spread, spread)
    rank, free = np.zeros(BITS, dtype=np.int64), np.ones(BITS, dtype=bool)
    at = int(np.argmax(p))
    for k in range(BITS):
        rank[at], free[at] = k, False
        if k + 1 < BITS:
            at = int(np.argmax(np.where(free, correlation[at], -np.inf)))
    return rank


def index_rows(classes: DataFrame, line: Line, num: int, den: int) -> DataFrame:
    """(key, less, c, n, part, own): each class at every level that probes it, by the tokens of each filled partition.

    less is 1 for the partition's tokens but one. own marks the class's own level, at which it probes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, "digests"):
            tokens, sizes = _flat(batch, "digests")
            ids = batch.column(batch.schema.get_field_index("c")).to_numpy(zero_copy_only=False)
            low, high = levels_of(sizes, num, den), levels_of(sizes * den // num, num, den)
            for step in range(int((high - low).max(initial=-1)) + 1):
                level = low + step
                some = np.repeat(level <= high, sizes)
                owner, own = np.repeat(np.arange(len(sizes)), sizes)[some], tokens[some]
                part = line.parts(own, PARTS << level[owner])
                value = _mixed(own + np.uint64(3))
                order = np.lexsort((part, owner))
                first = np.flatnonzero(np.r_[True, (owner[order][1:] != owner[order][:-1]) | (part[order][1:] != part[order][:-1])]) if len(own) else np.zeros(0, np.int64)
                total = np.add.reduceat(value[order], first) if len(own) else value
                inverse = np.empty(len(own), dtype=np.int64)
                inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(own)]))
                at = order[first]
                exact = _key(level[owner[at]], part[at], total)
                fewer = _key(level[owner], part, total[inverse] - value)
                who = np.concatenate([owner[at], owner])
                columns = [np.concatenate([exact, fewer]).view(np.int64), np.repeat([0, 1], [len(exact), len(fewer)]).astype(np.int8), ids[who], sizes[who].astype(np.int32), np.concatenate([part[at], part]).astype(np.int32), np.full(len(who), step == 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "less", "c", "n", "part", "own"])

    return classes.select("c", "digests").mapInArrow(rows, "key bigint, less tinyint, c bigint, n int, part int, own boolean")


def part_sizes(classes: DataFrame, line: Line, num: int, den: int) -> DataFrame:
    """(c, n, level, filled): how many of a class's tokens lie in each partition at its own level."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, "digests"):
            tokens, sizes = _flat(batch, "digests")
            level = levels_of(sizes, num, den)
            count = PARTS << level
            offsets = np.concatenate([[0], np.cumsum(count)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            filled = np.bincount(offsets[owner] + line.parts(tokens, count[owner]), minlength=offsets[-1])
            columns = [batch.column(batch.schema.get_field_index("c")), pa.array(sizes.astype(np.int32)), pa.array(level.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(filled.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "level", "filled"])

    return classes.select("c", "digests").mapInArrow(rows, "c bigint, n int, level int, filled array<int>")


def allocated(cost0: np.ndarray, cost1: np.ndarray, need: np.ndarray) -> np.ndarray:
    """T of each partition (columns) of each record (rows), -1, 0 or 1: sum(T + 1) >= need at the least cost.

    cost0 and cost1 are the candidates that T = 0 and T = 1 bring, FAR where that isn't possible; need can be met.
    """
    rows, parts = cost0.shape
    out = np.empty((rows, parts), dtype=np.int64)
    each = max(1, PLAN_BYTES // (parts * (int(need.max(initial=0)) + 1)))
    for at in range(0, rows, each):
        out[at : at + each] = _allocated(cost0[at : at + each], cost1[at : at + each], need[at : at + each])
    return out


def _allocated(cost0: np.ndarray, cost1: np.ndarray, need: np.ndarray) -> np.ndarray:
    rows, parts = cost0.shape
    most = int(need.max(initial=0))
    far = np.iinfo(np.int64).max // 4
    best = np.full((rows, most + 1), far, dtype=np.int64)
    best[:, 0] = 0
    taken = np.zeros((parts, rows, most + 1), dtype=np.int8)
    spent = np.arange(most + 1)
    for i in range(parts):
        new = best.copy()
        for step, cost in ((1, cost0), (2, cost1)):
            # states stand for "at least so much spent", so spending step reaches max(state - step, 0) of before
            other = best[:, np.maximum(spent - step, 0)] + cost[:, i : i + 1]
            better = other < new
            new[better] = other[better]
            taken[i][better] = step
        best = np.minimum(new, far)
    at, out = need.astype(np.int64), np.empty((rows, parts), dtype=np.int64)
    who = np.arange(rows)
    for i in reversed(range(parts)):
        step = taken[i, who, at]
        out[:, i] = step - 1
        at = np.maximum(at - step, 0)
    return out


def dealt(cost0: np.ndarray, cost1: np.ndarray, need: np.ndarray, block: int) -> np.ndarray:
    """How much of each record's need its blocks of partitions take: the units that cost least, wherever they lie."""
    rows, parts = cost0.shape
    second = np.where(cost1 < FAR, cost1 - cost0, FAR)
    even = (cost1 < FAR) & (second < cost0)  # the second unit is cheaper than the first: neither comes alone
    units = np.concatenate([np.where(even, cost1 / 2, cost0), np.where(even, cost1 / 2, second)], axis=1)
    where = np.tile(np.arange(parts) // block, 2)
    out = np.zeros((rows, parts // block), dtype=np.int64)
    for r in range(rows):
        out[r] = np.bincount(where[np.argsort(units[r], kind="stable")[: need[r]]], minlength=parts // block)
    return out


def thresholds(cost0: np.ndarray, cost1: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T of each partition of each record, which records can meet their need)."""
    able = (cost0 < FAR).sum(axis=1) + (cost1 < FAR).sum(axis=1) >= need
    out = np.full(cost0.shape, -1, dtype=np.int64)
    rows, parts = cost0.shape
    if not able.any():
        return out, able
    if parts <= BLOCK:
        out[able] = allocated(cost0[able], cost1[able], need[able])
    else:
        budget = dealt(cost0[able], cost1[able], need[able], BLOCK)
        cut = lambda x: x[able].reshape(-1, BLOCK)
        out[able] = allocated(cut(cost0), cut(cost1), budget.ravel()).reshape(-1, parts)
    return out, able


def probes(shapes: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """(key, c, n, near, m): what each class looks up. near: also index rows with one token less; m: index rows of the key.
    Classes whose filled partitions can't take their difference have one row without a key."""
    every = shapes.select("c", F.lit(0).alias("row"), "n", "level", "filled", *(F.lit(0).cast(t).alias(x) for x, t in (("part", "int"), ("less", "int"), ("key", "bigint"), ("n0", "bigint"), ("n1", "bigint"))))
    every = every.unionByName(info.select("c", F.lit(1).alias("row"), F.lit(0).alias("n"), F.lit(0).alias("level"), F.lit(None).cast("array<int>").alias("filled"), "part", F.col("less").cast("int").alias("less"), "key", "n0", "n1"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one class may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(c, c[-1]))
            if held and (last or held[0].column(0)[0].as_py() != c[-1]):
                yield from chosen([*held, batch.slice(0, last)])
                held = []
            elif last:
                yield from chosen([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from chosen(held)

    def chosen(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        column = lambda name: whole.column(name).to_numpy()
        shape = column("row") == 0
        c, n, level = (column(x)[shape].astype(np.int64) for x in ("c", "n", "level"))
        filled = pa.concat_arrays(whole.column("filled").filter(pa.array(shape)).chunks)
        starts = np.r_[0, np.cumsum(filled.value_lengths().to_numpy(zero_copy_only=False))]
        filled = filled.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        part, less, key, n0, n1 = (column(x)[~shape].astype(np.int64) for x in ("part", "less", "key", "n0", "n1"))
        owner = np.searchsorted(c, column("c")[~shape])
        bounds = np.searchsorted(owner, np.arange(len(c) + 1))
        for lv in np.unique(level):
            same = np.flatnonzero(level == lv)
            each = max(1, (1 << 21) // (PARTS << int(lv)))
            for at in range(0, len(same), each):
                some = same[at : at + each]
                own = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in some])
                k = np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some])
                full = np.stack([filled[starts[r] : starts[r + 1]] for r in some])
                yield planned(c[some], n[some], full, k, part[own], less[own], key[own], n0[own], n1[own])

    def planned(c: np.ndarray, n: np.ndarray, filled: np.ndarray, k: np.ndarray, part: np.ndarray, less: np.ndarray, key: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> pa.RecordBatch:
        cost0, same = np.zeros(filled.shape, dtype=np.int64), less == 0
        np.add.at(cost0, (k[same], part[same]), n0[same] - 1)
        cost1 = cost0.copy()
        np.add.at(cost1, (k[same], part[same]), n1[same])
        np.add.at(cost1, (k[~same], part[~same]), n0[~same])
        t, able = thresholds(np.where(filled > 0, cost0, FAR), np.where(filled > 1, cost1, FAR), difference(n, num, den) + 1)
        use = np.where(same, t[k, part] >= 0, t[k, part] >= 1)
        near = same & (t[k, part] >= 1)
        who = np.concatenate([k[use], np.flatnonzero(~able)])
        gone = np.repeat([False, True], [int(use.sum()), int((~able).sum())])
        pad = np.zeros(int((~able).sum()), dtype=np.int64)
        columns = [pa.array(np.concatenate([key[use], pad]), mask=gone), pa.array(c[who]), pa.array(n[who].astype(np.int32)), pa.array(np.concatenate([near[use], pad > 0])), pa.array(np.concatenate([(n0 + n1)[use], pad]))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "c", "n", "near", "m"])

    return every.repartition("c").sortWithinPartitions("c", "row").mapInArrow(choose, "key bigint, c bigint, n int, near boolean, m bigint")


def near_classes(classes: DataFrame, work: Workspace, num: int, den: int) -> DataFrame:
    """(c, d), c < d: all pairs of classes whose sets are num / den similar or more; classes as in problem 4. Exact."""
    classes = classes.select("c", "digests")
    count = classes.count()
    tokens = work.write(classes.select(F.explode("digests").alias("t")).groupBy("t").agg(F.count("*").alias("held")), "tokens")
    often = tokens.where(F.col("held") * COMMON > count).orderBy(F.desc("held"), "t").limit(MOST_COMMON)
    common = np.array([r["t"] for r in often.select("t").collect()], dtype=np.int64).view(np.uint64)  # at most MOST_COMMON
    line = Line(common, np.arange(BITS))
    line = Line(common, chained(co_occurrence(classes, line), count))
    index = work.write(index_rows(classes, line, num, den), "index")
    both = index.groupBy("key").agg(F.sum(F.lit(1) - F.col("less")).alias("n0"), F.sum("less").alias("n1")).withColumn("m", F.col("n0") + F.col("n1"))
    sums = work.write(both.select("key", "m", "n0", "n1").where("m > 1"), "sums")
    work.release()
    total = sums.agg(F.sum("m")).first()[0] or 0
    shared = work.write(lookup_by_count(index.select("key", "less", "c", "n", "part", "own"), sums, "key", "m", total), "shared")
    work.drop(index, sums)
    work.release()
    looked = work.write(probes(part_sizes(classes, line, num, den), shared.where("own"), num, den), "probes")
    work.release()
    fits = (F.col("c") != F.col("d")) & (F.col("k") <= F.col("n")) & (F.col("k") * den >= F.col("n") * num)
    kind = (F.col("less") == 0) | F.col("near")
    # a key with many index rows is met piece by piece
    pieces = F.ceil(F.col("m") / F.lit(PIECE)).cast("int")
    asked = looked.where("key is not null").select("key", "c", "n", "near", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    held = shared.select("key", F.pmod(F.xxhash64("c"), pieces).cast("int").alias("piece"), "less", F.col("c").alias("d"), F.col("n").alias("k"))
    met = asked.join(held, ["key", "piece"]).where(fits & kind).select("c", "d")
    rest = looked.where("key is null").select("c")
    if not rest.isEmpty():
        met = met.unionByName(by_tokens(rest, classes, tokens, num, den))
    pairs = work.write(met.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct(), "pairs")
    work.drop(shared, looked)
    work.release()
    return verified(pairs, classes, num, den)


def by_tokens(rest: DataFrame, classes: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(c, d): candidates of some classes by the tokens they hold. A partner that is num / den similar holds that share of a
    class's tokens at least, so also one of any larger number of them than it may lack; the rarest are taken."""
    lists = classes.join(rest, "c", "left_semi").select("c", F.size("digests").alias("n"), F.explode("digests").alias("t")).join(tokens, "t")
    rare = lists.groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("held", "t"))).alias("own"))
    prefix = F.slice("own", F.lit(1), F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}").cast("int") + 1)
    asked = rare.select("c", F.explode(prefix).alias("x")).select("c", "x.t")
    holders = classes.select(F.col("c").alias("d"), F.explode("digests").alias("t"))
    return asked.join(holders, "t").where("c <> d").select("c", "d").distinct()


def near_copies(records: DataFrame, key: str, array: str, work: Workspace, num: int, den: int, least: int = 1, links: DataFrame | None = None) -> DataFrame:
    """(id, group_id): records in groups of two or more, linked by sets num / den similar or by ``links`` (a, b).

    Sets hold distinct BIGINTs; null sets and those smaller than ``least`` link nothing. Keys are unique BIGINTs; extra
    columns are ignored. group_id is the least key of the group.
    """
    rows = records.where(F.size(array) >= max(least, 1)).select(F.col(key).alias("id"), F.col(array).alias("digests"))
    classes, members = classes_of(rows, "id", "digests", work)
    edges = near_classes(classes, work, num, den).select(F.col("c").alias("a"), F.col("d").alias("b"))
    edges = edges.unionByName(members.where("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b")))
    if links is not None:
        edges = edges.unionByName(links.select("a", "b"))
    return connected_groups(edges, "a", "b", work)


def score_reaches(score: Column, shared: Column, united: Column, num: int, den: int) -> Column:
    """A score text ('7/10', '0.7', '70%') is num / den or more; where it is null, shared / united is. Exact."""
    text = F.trim(score)
    ratio = F.split(text, "/")
    part = lambda i: F.try_element_at(ratio, F.lit(i)).try_cast("decimal(19,0)")
    number = F.regexp_replace(text, "%$", "").try_cast("decimal(30,15)")
    of_ratio = (part(2) > 0) & (part(1) * den >= part(2) * num)
    of_number = number * den >= F.when(text.endswith("%"), F.lit(100 * num)).otherwise(F.lit(num))
    of_weights = (united > 0) & (shared.cast("decimal(19,0)") * den >= united.cast("decimal(19,0)") * num)
    return F.coalesce(F.when(text.isNull() | (text == ""), of_weights).when(text.contains("/"), of_ratio).otherwise(of_number), F.lit(False))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Every entry in a group of near copies of two or more, with the smallest entry_id of the group."""
    work = Workspace(spark, "p5")
    entries = table(spark, sf_dir, "entries").select("entry_id", "rev", "fp_set")
    sets = work.write(counting_rows(effective_sets(entries, "fp_set"), "entry_id").drop("rev"), "sets")
    matches = existing_matches(spark, sf_dir, "a", "b", "match_kind", "score", "shared_w", "union_w").where("match_kind = 'unit' and a is not null and b is not null and a <> b")
    strong = matches.where(score_reaches(F.col("score"), F.col("shared_w"), F.col("union_w"), 7, 10)).select("a", "b")
    whole = table(spark, sf_dir, "locations").where("is_whole and entry_id is not null").select("loc_id", "entry_id").distinct()
    null = sets.select("entry_id", F.col("digests").isNull().alias("null_set"))
    side = whole.join(null, "entry_id")
    x = side.select(F.col("loc_id").alias("a"), F.col("entry_id").alias("ea"), F.col("null_set").alias("na"))
    y = side.select(F.col("loc_id").alias("b"), F.col("entry_id").alias("eb"), F.col("null_set").alias("nb"))
    links = strong.join(x, "a").join(y, "b").where("na or nb").select(F.col("ea").alias("a"), F.col("eb").alias("b"))
    groups = near_copies(sets, "entry_id", "digests", work, 7, 10, least=5, links=links)
    return groups.withColumnRenamed("id", "entry_id")
