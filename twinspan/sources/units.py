"""Files to units and nodes: the tables that the matcher starts from."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.operators.skew import in_order
from twinspan.sources import erb, ruby
from twinspan.sources.frontends import NODE_TYPES, NODES, tree_rows
from twinspan.work import Workspace

UNITS = "file_key string, unit_no int, kind string, identity string, namespace string, name string, start_line int, end_line int, language string, error_line int, error string, file_no int, nodes array<struct<preorder:int,subtree_end:int,parent:int,pos:int,depth:int,kind:string,label:string,start_line:int,end_line:int,is_sequence:boolean,digest:string,size:int,child_digests:array<string>>>"
_NODE = pa.struct(list(zip([x.split()[0] for x in NODES.split(", ")][1:], NODE_TYPES, strict=True)))
_NAMES = [*(x.split()[0] for x in UNITS[: UNITS.index(", nodes ")].split(", ")), "nodes"]

#: Rows are handed on when they hold so many nodes, or are so many.
_PIECE, _ROWS = 20_000, 1_000


def _read(path: str, language: str, text: str, trees: bool = True) -> Iterator[tuple]:
    """Rows of a file's units, or one row with its error. A unit's node rows are made when it is asked for; without trees
    there are none, but the same errors."""
    rows = tree_rows if trees else lambda tree: None
    try:
        if language == "erb":
            lines = max(text.count("\n") + (bool(text) and not text.endswith("\n")), 1)
            found = [("template", erb.identity(path), None, None, 1, lines, None, None, erb.template_tree(text))]
        else:
            found = [(u.kind, u.identity, u.namespace, u.name, u.start_line, u.end_line, None, None, tree) for u, tree in ruby.unit_trees(text)]
    except ruby.Unreadable as e:
        found = [(None, None, None, None, None, None, e.line, str(e), None)]
    except RecursionError:
        found = [(None, None, None, None, None, None, 1, "nested too deeply", None)]
    for r in found:
        yield (*r[:8], None if r[8] is None else rows(r[8]))


def _batch(rows: list[tuple], trees: bool) -> pa.RecordBatch:
    """Rows of units, their trees' nodes column by column."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    if trees:
        nodes = [x for r in rows for x in r[12] or ()]
        flat = pa.StructArray.from_arrays([pa.array([x[k] for x in nodes], f.type) for k, f in enumerate(_NODE)], fields=list(_NODE))
        ends = list(accumulate((len(r[12] or ()) for r in rows), initial=0))
        offsets = [None if k < len(rows) and rows[k][12] is None else end for k, end in enumerate(ends)]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES[: len(columns)])


@contextmanager
def _seldom_collected() -> Iterator[None]:
    """Python looks for garbage once in so many new objects; a file's tree is made of thousands, few of them in cycles."""
    usual = gc.get_threshold()
    gc.set_threshold(100_000, *usual[1:])
    try:
        yield
    finally:
        gc.set_threshold(*usual)


def unit_batches(batches: Iterable[pa.RecordBatch], trees: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of units of batches of files (key, path, language, text). A batch holds few nodes more than ``_PIECE``, but
    those of one unit, however many files Spark gives at once. file_no counts the files with units."""
    rows: list[tuple] = []
    held, files = 0, -1
    with _seldom_collected():
        for batch in batches:
            for at in range(batch.num_rows):
                own, where, lang, value = (c[at].as_py() for c in batch.columns)
                if value is None or lang not in ("ruby", "erb"):
                    continue
                for k, r in enumerate(_read(where or "", lang, value, trees)):
                    files += k == 0 and r[6] is None
                    rows.append((own, k, *r[:6], lang, *r[6:8], files if r[6] is None else None, r[8]))
                    held += len(r[8] or ())
                    if held >= _PIECE or len(rows) >= _ROWS:
                        yield _batch(rows, trees)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, trees)


def read_units(files: DataFrame, key: str, path: str, language: str, text: str, trees: bool = True) -> DataFrame:
    """A row per unit of each Ruby or ERB file, with its tree, or one with the file's error; other languages and null texts
    give none. Files are read where they are: no shuffle. Without trees there is no column of nodes."""
    rows = files.select(F.col(key).cast("string").alias("_k"), F.col(path).alias("_p"), F.col(language).alias("_l"), F.col(text).alias("_t"))
    return rows.mapInArrow(lambda batches: unit_batches(batches, trees), UNITS if trees else UNITS[: UNITS.index(", nodes ")])


#: A file's units are numbered within its own range of so many bits.
_BITS = 20


def numbered_units(rows: DataFrame, paths: DataFrame, work: Workspace) -> DataFrame:
    """(entry_id, path, ...): units numbered in the order of path and place in the file, with gaps between files. paths:
    (file_key, path). Files are ranked by a distributed sort and counts per partition; no task sees all of them."""
    good = rows.where("error is null").join(paths, "file_key")
    ranked = in_order(good.select("path").distinct(), "path", "_rank", work)
    order = F.row_number().over(Window.partitionBy("path").orderBy("unit_no"))
    return good.withColumn("_own", order).join(ranked, "path").withColumn("entry_id", F.shiftleft("_rank", _BITS) + F.col("_own")).drop("_own", "_rank")


def units_in_order(files: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, nodes, errors) of files (path, language, text), each path once: units numbered as by ``numbered_units``, their
    node rows, and (path, line, message) of files that can't be read. Files are dealt by ranges of their paths before they
    are read; each task counts its files with units and the tasks' counts do the rest, so no tree is shuffled."""
    spark = files.sparkSession
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = files.select("path", "language", "text").repartitionByRange(pieces, "path").sortWithinPartitions("path")
    read = work.write(read_units(ordered, "path", "path", "language", "text").withColumn("_part", F.spark_partition_id()), "read")
    good = read.where("error is null")
    sizes = good.where("unit_no = 0").groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.write(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    entry = F.shiftleft(F.col("_start") + F.col("file_no"), _BITS) + F.col("unit_no") + 1
    numbered = good.join(F.broadcast(starts), "_part").withColumn("entry_id", entry)
    listed = work.write(numbered.select("entry_id", F.col("file_key").alias("path"), "kind", "identity", "namespace", "name", "start_line", "end_line", "language"), "units")
    nodes = work.write(unit_nodes(numbered), "nodes")
    errors = work.write(read.where("error is not null").select(F.col("file_key").alias("path"), F.col("error_line").alias("line"), F.col("error").alias("message")), "errors")
    work.drop(read)
    return listed, nodes, errors


def unit_nodes(units: DataFrame) -> DataFrame:
    """Node rows of units with their trees."""
    names = [x.split()[0] for x in NODES.split(", ")][1:]
    return units.select(F.col("entry_id").cast("bigint").alias("entry_id"), F.explode("nodes").alias("x")).select("entry_id", *(f"x.{n}" for n in names))


def unit_errors(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, line, message) of files that can't be read."""
    return rows.where("error is not null").join(paths, "file_key").select("path", F.col("error_line").alias("line"), F.col("error").alias("message"))
