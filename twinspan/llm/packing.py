"""Problem 7: filling fixed-capacity containers with items, by best-fit decreasing.

Items are taken from the largest to the smallest, and each goes into the open container with the least room that takes it.
A segment tree over remaining capacities finds that container in logarithmic time. Which of equal items, and which of
equally full containers, is taken makes no difference to what follows, so the rule is run on counts: on how many items have
each size, and on ranges of equally full containers. A range of n containers with room r takes n * (r // size) items of a
size at once, as a container that took one is then the tightest until no more go in. This halves a range's room at least,
so the plan has at most about capacity * log2(capacity) rows, whatever the number of items, and is made at the driver from
at most capacity + 1 counts. It is the packing of best-fit decreasing over all items, not one of shards put together.

Items find their places by their rank among those of their size. Ranks come from a window over (size, bucket), whose
buckets have about BUCKET items each, and sums of the buckets' counts, so no task holds all items of a common size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.llm.tokens import VOCABULARY, encoder
from twinspan.sources.tables import spread, table
from twinspan.work import Workspace

CAPACITY = 2048
#: Largest capacity: a bound on the counts and the plan, which are kept at the driver.
MOST_CAPACITY = 1 << 20
#: Items of a bucket: a bound on the memory of one task.
BUCKET = 100_000
#: Bits of a rank in a plan's keys.
_RANK = 42


class RemainingTree:
    """Segment tree over remaining capacities 0..capacity: how many ranges of open containers have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(capacity, 1).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, containers: int) -> None:
        """Containers from number ``first`` on, each with that much room."""
        if not containers:
            return
        self.open[remaining].append((first, containers))
        i = remaining + self.leaves
        while i:
            self.counts[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int, int] | None:
        """The (remaining, first, containers) with the least remaining capacity of at least size, taken out of the tree."""
        counts, i = self.counts, size + self.leaves
        while not counts[i]:
            while i & 1:  # a right child: what is right of it lies right of its parent
                i >>= 1
                if i <= 1:
                    return None
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            if not counts[i]:
                i += 1
        remaining = i - self.leaves
        first, containers = self.open[remaining].pop()
        while i:
            counts[i] -= 1
            i >>= 1
        return remaining, first, containers


def planned(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The plan of best-fit decreasing and how many containers it opens.

    counts: how many items have each size, 1 to capacity. The plan's rows are (size, rank, each, container): items of a
    size from that rank on lie, ``each`` to a container, in the containers from that number on.
    """
    tree, plan, used = RemainingTree(capacity), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room, first, containers = tree.take(size) or (capacity, used, -(-left // (capacity // size)))
            if first == used:
                used += containers
            each = room // size
            whole, rest = min(divmod(left, each), (containers, 0))
            if whole:
                plan.append((size, rank, each, first))
                tree.add(room - each * size, first, whole)
            if rest:
                plan.append((size, rank + whole * each, rest, first + whole))
                tree.add(room - rest * size, first + whole, 1)
            tree.add(room, first + whole + (rest > 0), containers - whole - (rest > 0))
            rank, left = rank + whole * each + rest, left - whole * each - rest
    return np.array(plan, dtype=np.int64).reshape(-1, 4), used


def placed(plan: np.ndarray, used: int, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The container of each item, by its size and its rank among those of its size; items of size 0 go round all."""
    keys = (plan[:, 0] << _RANK) + plan[:, 1]
    order = np.argsort(keys)
    at = order[np.maximum(np.searchsorted(keys[order], (sizes << _RANK) + ranks, side="right") - 1, 0)] if len(plan) else np.zeros(len(sizes), np.int64)
    if not len(plan):
        return np.zeros(len(sizes), dtype=np.int64)
    return np.where(sizes > 0, plan[at, 3] + (ranks - plan[at, 1]) // plan[at, 2], ranks % max(used, 1))


def token_counts(documents: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, size): tokens of each row's text; null and empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            sizes = [own.count(x) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "size"])

    return documents.select(key, text).mapInArrow(count, f"`{key}` {documents.schema[key].dataType.simpleString()}, size bigint")


def packed(items: DataFrame, key: str, size: str, work: Workspace, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """(container, key, piece, start, size): every item in one container, or, if larger than one, cut at the capacity.

    Pieces are numbered from 0; start is where a piece begins in its item. Only items larger than the capacity are cut:
    into full pieces, each a container of its own, and a rest that is packed like any item. A null, zero or negative size
    takes no room; such items are placed evenly over all containers (over one, if there is nothing else). Containers are
    numbered from 0. Keys may be null or repeated; one of equal items is as good as another.
    """
    if not 1 <= capacity <= MOST_CAPACITY or bucket < 1:
        raise ValueError(f"capacity must be from 1 to {MOST_CAPACITY}, and a bucket at least 1")
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    rows = work.write(items.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), n.alias("_n")), "items")
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest(_n - 1, 0) div {capacity}"))).alias("piece"))
    pieces = pieces.select("_row", "_key", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).alias("size"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    plan, used = planned({s: c for s, c in counts.items() if s}, capacity)
    buckets = max(-(-sum(counts.values()) // bucket), 1)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row", "piece"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("size", "_bucket").agg(F.count("*").alias("n")).select("size", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("size", "_bucket").orderBy("_row", "piece")
    ranked = pieces.withColumn("_rank", F.row_number().over(own) - 1).join(sums, ["size", "_bucket"])
    ranked = ranked.select("_key", "piece", "start", "size", (F.col("_rank") + F.col("_before")).alias("_rank"))
    shared = items.sparkSession.sparkContext.broadcast((plan, used))  # its rows are bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = placed(*shared.value, *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4)))
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns[:4]], names=["container", key, "piece", "start", "size"])

    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"container bigint, `{key}` {kind}, piece bigint, start bigint, size bigint")


def p7_containers(spark, sf_dir: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens of byte_bpe_50k."""
    sizes = token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return packed(sizes, "doc_id", "size", Workspace(spark, "p7"))


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """One row: containers, tokens, and the share of the containers' room that tokens fill."""
    each = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("filled"))
    return each.agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"), (F.sum("filled") / (F.count("*") * CAPACITY)).alias("fill"))
