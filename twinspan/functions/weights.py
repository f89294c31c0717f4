"""Rarity weights and exact scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the weight: round(ln(1 + RARITY / df) * SCALE).
RARITY, SCALE = 1000, 1_000_000


def weight(df: Column | str) -> Column:
    """The fixed-point weight of a digest that df units hold; an unknown digest (null) counts as held by one."""
    count = F.coalesce(F.col(df) if isinstance(df, str) else df, F.lit(1)).cast("double")
    return F.round(F.log1p(F.lit(float(RARITY)) / count) * SCALE).cast("bigint")


def reaches(shared: Column, united: Column, num: int | Column, den: int | Column) -> Column:
    """shared / united >= num / den without division; an empty union scores 0."""
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(19,0)")
    return (united > 0) & (wide(shared) * wide(den) >= wide(united) * wide(num))


def exact_threshold(text: Column) -> Column:
    """A decimal spelling of a threshold ('.85', '0.80') in millionths; null where it is none or not in (0, 1]."""
    value = F.trim(text).try_cast("decimal(18,6)")
    return F.when((value > 0) & (value <= 1), (value * 1_000_000).cast("bigint"))
