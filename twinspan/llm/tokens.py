"""Problem 6: encoding of the whole corpus with a public tokenizer, by content-defined chunk reuse.

Texts are cut where a rolling hash of the last WINDOW code points meets a mask, so passages shared by documents give the
same chunks wherever they stand. A chunk alone is split differently near its ends than within its text, so it is trimmed to
its first and last sure boundary, each distinct trimmed chunk is encoded once, and the text between two trimmed chunks, a
few words, is encoded for itself. A sure boundary is one that the tokenizer's split has whatever stands around it: between a
visible character and a blank, or between a letter and a full stop of scripts without blanks. No piece of the split spans
one or looks across it, so ids before and after it don't depend on each other and the parts' ids are those of the whole
text. Where a chunk has no such boundary, the join goes on through it to the next that has.

The vocabulary file's path is a parameter; only the path travels to the executors, each of which reads it once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.skew import lookup_by_count
from twinspan.sources.tables import spread, table
from twinspan.work import Workspace

#: Rank file of the tokenizer byte_bpe_50k.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges: fixed value of the public tokenizer. Sure boundaries follow from it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, MASK, LEAST, MOST = 16, 0x1FF, 32, 4096
_CACHED = 200_000


class Encoder:
    """The tokenizer, with a bounded memory of short texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.bpe.encode_ordinary(text))

    def join(self, text: str) -> list[int]:
        """Ids of the text between two chunks, which is often the same few words."""
        ids = self.cache.get(text)
        if ids is None:
            ids = self.encode(text)
            if len(text) <= 48:
                if len(self.cache) >= _CACHED:
                    self.cache.clear()
                self.cache[text] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _rolling(codes: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW code points at each place."""
    h, width, power = codes * np.uint32(0x9E3779B1), 1, 0x01000193
    while width < WINDOW:
        rolled = h.copy()
        rolled[width:] += h[:-width] * np.uint32(pow(power, width, 2**32))
        h, width = rolled, width * 2
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def _sure(codes: np.ndarray) -> np.ndarray:
    """Places between code points that are boundaries of the split whatever stands around them (not all such places)."""
    after, before = codes[1:], codes[:-1]
    blank = (after == 32) | ((after >= 9) & (after <= 13))
    visible = ((before > 32) & (before < 127)) | ((before >= 0xC0) & (before < 0x1680)) | (before > 0x3000)
    letter = ((before >= 0x4E00) & (before <= 0x9FA5)) | ((before >= 0x3041) & (before <= 0x3096)) | ((before >= 0x30A1) & (before <= 0x30FA))
    stop = (after == 0x3001) | (after == 0x3002) | (after == 0xFF01) | (after == 0xFF0C) | (after == 0xFF1F)
    return np.flatnonzero((blank & visible) | (stop & letter)) + 1


def _ends(marks: list[int], start: int, end: int) -> list[int]:
    """Where the chunks of the text from start to end stop."""
    out, at = [], start
    for mark in [*marks, end]:
        while mark - at > MOST:
            at += MOST
            out.append(at)
        if mark - at >= LEAST or mark == end > at:
            at = mark
            out.append(at)
    return out


def cut(texts: list[str]) -> list[list[tuple[str, str | None]]]:
    """Of each text the (join, chunk) pairs that make it up, in order; chunk is None in a last pair without one."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = np.flatnonzero((_rolling(codes) >> np.uint32(16) & np.uint32(MASK)) == 0) + 1
    sure = _sure(codes)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - [len(t) for t in texts]
    first, last = np.searchsorted(marks, starts + WINDOW), np.searchsorted(marks, ends)
    listed = marks.tolist()
    chunks = [_ends(listed[first[k] : last[k]], start, end) for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
    flat = np.array([x for each in chunks for x in each], dtype=np.int64)
    begin = np.array([x for start, each in zip(starts.tolist(), chunks, strict=True) for x in [start, *each[:-1]][: len(each)]], dtype=np.int64)
    # each chunk's first and last sure boundary; a text's own two ends are sure
    bounds = np.append(sure, np.iinfo(np.int64).max)
    heads = np.where(np.isin(begin, starts), begin, bounds[np.searchsorted(sure, begin)]).tolist()
    at = np.searchsorted(sure, flat, side="right") - 1
    tails = np.where(np.isin(flat, ends), flat, np.where(at >= 0, bounds[at], -1)).tolist()
    out, k = [], 0
    for start, end, each in zip(starts.tolist(), ends.tolist(), chunks, strict=True):
        done, parts = start, []
        for _ in each:
            head, tail = heads[k], tails[k]
            k += 1
            if head < tail:
                parts.append((whole[done:head], whole[head:tail]))
                done = tail
        if done < end or not parts:
            parts.append((whole[done:end], None))
        out.append(parts)
    return out


def encoded(documents: DataFrame, key: str, text: str, work: Workspace, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens; null and empty texts give an empty list.

    One row out per row in, also where keys repeat or are null. Special tokens' strings in a text are ordinary text.
    """
    kind = documents.schema[key].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                made = cut([x or "" for x in batch.column(2).to_pylist()])
                owner = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]))
                pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in made])
                joins, chunks = (pa.array([part[k] for x in made for part in x], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(pos), joins, chunks], names=["_row", "_key", "pos", "joint", "chunk"])

    rows = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    chunks = rows.mapInArrow(parts, f"_row bigint, _key {kind}, pos int, joint string, chunk string").withColumn("key", F.unhex(F.md5("chunk")))
    chunks = work.write(chunks, "chunks")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(2).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "n", "ids"])

    distinct = chunks.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("chunk").alias("chunk"))
    known = work.write(distinct.mapInArrow(encode, "key binary, n bigint, ids array<int>"), "known")
    total = known.agg(F.sum("n")).first()[0] or 0
    narrow = chunks.select("_row", "_key", "pos", "joint", "key")
    joined = lookup_by_count(narrow.where("key is not null"), known, "key", "n", total).select("_row", "_key", "pos", "joint", "ids")
    joined = joined.unionByName(narrow.where("key is null").select("_row", "_key", "pos", "joint", F.array().cast("array<int>").alias("ids")))
    texts = joined.groupBy("_row").agg(F.first("_key").alias("_key"), F.array_sort(F.collect_list(F.struct("pos", "joint", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            joints = [own.join(x) if x else [] for x in flat.field("joint").to_pylist()]
            ids = flat.field("ids")
            bodies = ids.flatten().to_numpy(zero_copy_only=False)
            body = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            joint = np.array([len(x) for x in joints], dtype=np.int64)
            stops = np.cumsum(joint + body)
            out = np.empty(stops[-1] if len(stops) else 0, dtype=np.int32)
            starts = stops - joint - body
            between = np.fromiter((i for x in joints for i in x), dtype=np.int32, count=int(joint.sum()))
            out[np.arange(len(between)) + np.repeat(starts - (np.cumsum(joint) - joint), joint)] = between
            out[np.arange(len(bodies)) + np.repeat(starts + joint - (np.cumsum(body) - body), body)] = bodies
            offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, stops][offsets].astype(np.int32)), pa.array(out))], names=[key, "ids"])

    return texts.select("_key", "parts").mapInArrow(join, f"`{key}` {kind}, ids array<int>")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded(documents, "doc_id", "text", Workspace(spark, "p6"))
