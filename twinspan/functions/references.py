"""References to units: methods, constants, and globs over constants and templates."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reference_kind(text: Column) -> Column:
    """template_glob, method, const_glob or constant."""
    return F.when(text.contains("/"), "template_glob").when(text.rlike("[#.]"), "method").when(text.contains("*"), "const_glob").otherwise("constant")


def specificity(text: Column) -> Column:
    """An array that orders references from the widest to the narrowest: methods, then literal segments, segments, fewer
    double stars, longer text."""
    kind = reference_kind(text)
    parts = F.when(kind == "template_glob", F.split(text, "/")).otherwise(F.split(text, "::"))
    literal = F.size(F.filter(parts, lambda x: ~x.contains("*")))
    doubles = F.size(F.filter(parts, lambda x: x == "**"))
    zero, length = F.lit(0), F.length(text)
    return F.when(kind == "method", F.array(F.lit(1), zero, zero, zero, length)).otherwise(F.array(zero, literal, F.size(parts), -doubles, length))


@lru_cache(maxsize=10_000)
def _segment(pattern: str) -> re.Pattern:
    """A file-name pattern: *, ?, [sets] and backslash escapes; a leading dot is matched by a dot alone."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("(?!\\.).*" if k == 0 else ".*")
        elif c == "?":
            out.append("[^.]" if k == 0 else ".")
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            k = end
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return re.compile("".join(out), re.S)


def segments_match(patterns: list[str], segments: list[str]) -> bool:
    """A glob by segments, in which ** stands for any number of them: the set of positions that the patterns so far can
    end at, so the time is at most patterns times segments whatever the glob."""
    ends = {0}
    for pattern in patterns:
        if pattern == "**":
            ends = set(range(min(ends), len(segments) + 1)) if ends else ends
        else:
            own = _segment(pattern)
            ends = {e + 1 for e in ends if e < len(segments) and own.fullmatch(segments[e])}
        if not ends:
            return False
    return len(segments) in ends


@lru_cache(maxsize=10_000)
def template_pattern(text: str) -> re.Pattern:
    """A glob over template identities: ** spans folders, * does not."""
    out, k = [], 0
    while k < len(text):
        if text.startswith("/**/", k):
            out.append("/(?:.*/)?")
            k += 4
        elif text.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif text[k:] == "/**":
            out.append("/.*")
            k += 3
        elif text.startswith("**", k):
            out.append(".*")
            k += 2
        elif text[k] == "*":
            out.append("[^/]*")
            k += 1
        else:
            out.append(re.escape(text[k]))
            k += 1
    return re.compile("".join(out))


@F.pandas_udf(T.IntegerType())
def glob_depth(reference: pd.Series, namespace: pd.Series) -> pd.Series:
    """Segments of the longest prefix of a namespace that a constant glob matches; null where it matches none."""

    def depth(ref: str | None, name: str | None) -> int | None:
        if ref is None or name is None:
            return None
        patterns, parts = ref.split("::"), name.split("::")
        return next((k for k in range(len(parts), 0, -1) if segments_match(patterns, parts[:k])), None)

    known: dict[tuple[str | None, str | None], int | None] = {}
    out = []
    for pair in zip(reference, namespace, strict=True):
        if pair not in known:
            known[pair] = depth(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.BooleanType())
def template_matches(reference: pd.Series, identity: pd.Series) -> pd.Series:
    """Does a template glob match an identity?"""
    return pd.Series([bool(r is not None and i is not None and template_pattern(r).fullmatch(i)) for r, i in zip(reference, identity, strict=True)])
