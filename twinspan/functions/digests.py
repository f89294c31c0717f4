"""Digests: unsigned 64-bit numbers, spelled as hexadecimal text in any of several ways.

Inside the engine a digest is a BIGINT with the sign bit flipped, so that signed order is the order of the unsigned
numbers. Text is made only at the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEX = np.full(256, 255, dtype=np.uint8)
for _i, _c in enumerate("0123456789abcdef"):
    _HEX[ord(_c)] = _i
_FLIP = np.uint64(1 << 63)


def digest_text(col: Column | str) -> Column:
    """A flipped BIGINT as 16 lower-case hexadecimal digits."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0"))


def digest_number(col: Column | str) -> Column:
    """The flipped BIGINT of a spelling (blanks around, 0x before, any case, leading zeros); null where it is none."""
    c = F.col(col) if isinstance(col, str) else col
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "[\\t\\r\\n]", " "))), "^0x", "")
    number = F.conv(plain, 16, -10).cast("bigint").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
    return F.when(plain.rlike("^0*[0-9a-f]{1,16}$"), number)


def _numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flipped numbers of spellings and which of them are valid."""
    texts = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero((size != 16) | pc.starts_with(texts, "0x").to_numpy(zero_copy_only=False))
    if len(odd):
        some = pc.replace_substring_regex(texts.take(pa.array(odd)), r"^0x", "")
        blank = pc.equal(some, "")
        some = pc.utf8_ltrim(some, "0")
        some = pc.utf8_lpad(some, 16, "0")
        some = pc.if_else(blank, pa.scalar("", pa.large_string()), some)
        position = np.full(len(texts), -1, dtype=np.int64)
        position[odd] = np.arange(len(odd))
        both = pa.concat_arrays([texts, some])
        index = np.where(position >= 0, len(texts) + position, np.arange(len(texts)))
        texts = both.take(pa.array(index))
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    right = size == 16
    flat = np.frombuffer(texts.filter(pa.array(right)).to_numpy(zero_copy_only=False).astype("S16").tobytes(), dtype=np.uint8) if right.any() else np.empty(0, np.uint8)
    digits = _HEX[flat].reshape(-1, 16)
    valid = np.zeros(len(size), dtype=bool)
    good = (digits != 255).all(axis=1)
    valid[np.flatnonzero(right)[good]] = True
    pairs = (digits[good, 0::2] << 4) | digits[good, 1::2]
    numbers = np.zeros(len(size), dtype=np.uint64)
    numbers[valid] = np.ascontiguousarray(pairs).view(">u8").ravel().astype(np.uint64) ^ _FLIP
    return numbers.view(np.int64), valid


def effective_sets(df: DataFrame, array: str, out: str = "digests") -> DataFrame:
    """Replace the text array by the sorted distinct digests in it, as flipped BIGINTs; a null array stays null.

    Nulls, blanks and texts that spell no 64-bit number add nothing. An empty array gives an empty set.
    """
    keep = [c for c in df.columns if c != array]
    fields = [df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.LongType(), False), True)]

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(array))
            null = lists.is_null().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers, valid = _numbers(lists.flatten())
            owner = np.repeat(np.arange(len(sizes)), sizes)[valid]
            numbers = numbers[valid]
            order = np.lexsort((numbers, owner))
            owner, numbers = owner[order], numbers[order]
            if len(owner):
                first = np.r_[True, (owner[1:] != owner[:-1]) | (numbers[1:] != numbers[:-1])]
                owner, numbers = owner[first], numbers[first]
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            np.cumsum(np.bincount(owner, minlength=len(sizes)), out=offsets[1:])
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers, pa.int64()))
            if null.any():
                sets = pc.if_else(pa.array(null), pa.scalar(None, sets.type), sets)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [sets], names=[*keep, out])

    return df.select(*keep, array).mapInArrow(normal, T.StructType(fields))
