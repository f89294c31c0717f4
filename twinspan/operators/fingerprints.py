"""Digests of trees and statistics of digest sets.

A nodes table has a row per tree node: (entry_id, preorder, subtree_end, parent, pos, depth, kind, label, start_line,
end_line, is_sequence). subtree_end is the last preorder in the node's subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspan.functions.weights import weight
from twinspan.operators.skew import lookup_by_count


def node_digest(kind: str, label: str | None, children: list[bytes]) -> bytes:
    """First eight bytes of SHA-256 over kind, label and the children's digests, big-endian."""
    return hashlib.sha256(kind.encode() + b"\0" + (label or "").encode() + b"\0" + b"".join(children)).digest()[:8]


def run_digest(digests: Column) -> Column:
    """The digest, as 16 hexadecimal digits, of a run of siblings given as an array of such digits."""
    return F.substring(F.sha2(F.unhex(F.array_join(digests, "")), 256), 1, 16)


def node_digests(rows: Sequence[tuple[int, int, int, str, str | None]]) -> tuple[list[str], list[int], list[list[str]]]:
    """Digests, sizes and children's digests of a tree's rows (preorder, parent, pos, kind, label), which come in preorder."""
    digests: dict[int, bytes] = {}
    sizes: dict[int, int] = {}
    children: dict[int, list[tuple[int, int]]] = {}
    lists: dict[int, list[str]] = {}
    for at, parent, pos, kind, label in reversed(rows):
        own = [x for _, x in sorted(children.pop(at, []))]
        digests[at] = node_digest(kind, label, [digests[x] for x in own])
        sizes[at] = 1 + sum(sizes[x] for x in own)
        lists[at] = [digests[x].hex() for x in own]
        if parent >= 0:
            children.setdefault(parent, []).append((pos, at))
    order = [r[0] for r in rows]
    return [digests[x].hex() for x in order], [sizes[x] for x in order], [lists[x] for x in order]


def digested(nodes: DataFrame) -> DataFrame:
    """Add digest (16 hexadecimal digits), size and child_digests to a nodes table.

    One shuffle by entry; an entry's tree is built in one task, as it comes from one file. Front ends, which hold the tree
    when they make its rows, add the same columns without a shuffle.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", digest string, size int, child_digests array<string>"

    def bottom_up(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("preorder", kind="stable")
        rows = [(int(a), -1 if p is None or p != p else int(p), int(o), k, None if x is None or x != x else x) for a, p, o, k, x in zip(tree["preorder"], tree["parent"], tree["pos"], tree["kind"], tree["label"], strict=True)]
        digests, sizes, lists = node_digests(rows)
        return tree.assign(digest=digests, size=sizes, child_digests=lists)

    return nodes.groupBy("entry_id").applyInPandas(bottom_up, schema)


def digest_counts(sets: DataFrame, array: str = "digests") -> DataFrame:
    """(digest, df, w): how many sets hold each digest, and its weight. All sets count; null sets and digests do not."""
    rows = sets.select(F.explode(array).alias("digest")).where("digest is not null")
    return rows.groupBy("digest").agg(F.count("*").alias("df")).withColumn("w", weight("df"))


def weighted_rows(sets: DataFrame, counts: DataFrame, key: str, array: str = "digests") -> DataFrame:
    """(key, digest, df, w) of every digest of every set; hot digests are looked up by broadcast."""
    total = counts.agg(F.sum("df")).first()[0] or 0
    return lookup_by_count(sets.select(key, F.explode(array).alias("digest")), counts, "digest", "df", total)


def totals(rows: DataFrame, key: str) -> DataFrame:
    """(key, total, digests): the weight and number of each set's digests."""
    return rows.groupBy(key).agg(F.sum("w").alias("total"), F.count("*").alias("digests"))


def prefixes(rows: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """(key, digest, df, w, total): of each set, rarest first, the digests taken while the weight taken before is at most
    (1 - num / den) of the total. Two sets that reach num / den share one of them."""
    order = Window.partitionBy(key).orderBy("df", "digest")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("total", F.sum("w").over(Window.partitionBy(key))).withColumn("_before", before)
    return marked.where(F.col("_before") * den <= F.col("total") * (den - num)).drop("_before")


def child_trigrams(sequences: DataFrame, key: str, digests: str) -> DataFrame:
    """(key, at, gram): every three neighbouring digests of each sequence, with where they begin (from 0)."""
    starts = F.when(F.size(digests) >= 3, F.sequence(F.lit(0), F.size(digests) - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(F.col(digests), i + 1, 3), " ").alias("gram")))
    return sequences.select(key, F.explode(grams).alias("g")).select(key, "g.at", "g.gram")


def ordinals(rows: DataFrame, group: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """Number the rows of each group from 1 in an order: repeats of an identity, of a subtree, of a run."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
