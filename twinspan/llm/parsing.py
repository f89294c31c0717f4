"""Problem 2: source files that do not parse.

Bundled grammars of Ruby, HTML with Ruby in tags, JSON and Python give LALR(1) tables; each file's whole token stream is
parsed by its language's tables, and the first token that no text with that beginning can have is the file's error. There is
no recovery, so a file has one error at most. The language is the one its extension names. Names need not be defined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.grammars import erb_text, lr
from twinspan.llm.grammars import json_text, python_text
from twinspan.sources.tables import spread, table

#: Extensions and their languages.
EXTENSIONS = {"rb": "ruby", "erb": "erb", "json": "json", "py": "python"}


@lru_cache(maxsize=1)
def _tables() -> dict[str, lr.Tables]:
    return {"json": lr.build(json_text.GRAMMAR), "python": lr.build(python_text.GRAMMAR), "erb": lr.build(erb_text.GRAMMAR), "ruby": erb_text.ruby_tables()}


@lru_cache(maxsize=2)
def _asked(language: str) -> frozenset[int]:
    """The rules whose tokens are looked at: elements' tags must be a pair, and Python's ``python_text.CHECKED``."""
    rules = _tables()[language].rules
    return frozenset(k for k, r in enumerate(rules) if (r == ("node", 3) if language == "erb" else r[0] in python_text.CHECKED))


def _line(text: str, place: int) -> int:
    return text.count("\n", 0, place) + 1


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """(line, message) of the first error in a text, or None where the language's grammar has the text."""
    tables = _tables()[language]
    if language == "json":
        kinds, places = json_text.tokens(text)
        k = lr.parse(tables, kinds)
        return None if k is None else _message(kinds, k, _line(text, places[k] if k < len(places) else len(text)))
    if language == "python":
        kinds, lines = python_text.tokens(text)
        k = lr.parse(tables, kinds, lambda rule, first, last: python_text.fits(kinds, tables.rules[rule][0], first, last), _asked(language))
        return None if k is None else _message(kinds, k, lines[k] if k < len(lines) else _line(text, len(text)))
    if language == "ruby":
        place = erb_text.ruby_error(text)
        return None if place is None else (_line(text, place), f"unexpected {_seen(text, place)}")
    kinds, places, names, codes = erb_text.tokens(text)

    def reduced(rule: int, first: int, last: int) -> bool:
        return kinds[first] != "OPEN" or first + 1 > last - 1 or kinds[last - 1] != "CLOSE" or names[first] == names[last - 1]

    k = lr.parse(tables, kinds, reduced, _asked(language))
    if k is not None:
        return _message(kinds, k, _line(text, places[k] if k < len(places) else len(text)))
    program = "\n".join(code for _, code in codes)
    place = erb_text.ruby_error(program)
    if place is None:
        return None
    seen = 0
    for start, code in codes:
        if seen + len(code) >= place:
            return _line(text, start), f"unexpected {_seen(program, place)}"
        seen += len(code) + 1
    return _line(text, len(text)), "unexpected end of the code"


def _message(kinds: list[str], k: int, line: int) -> tuple[int, str]:
    if k >= len(kinds):
        return line, "unexpected end of the file"
    return line, "text that no token begins with" if kinds[k] == "ERROR" else f"unexpected {kinds[k]}"


def _seen(text: str, place: int) -> str:
    return repr(text[place : place + 20].split("\n")[0]) if place < len(text) else "end of the file"


def language_of(path: Column) -> Column:
    """The language that a path's extension names; null for others."""
    pairs = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def judged(files: DataFrame, key: str, path: str, content: str, *others: str) -> DataFrame:
    """(key, others, language, line_no, message), a row for each row: line and message are null where a file parses, and
    where there is nothing to parse; language is null where there is nothing to parse. Parsed where read: no shuffle."""
    kept = [key, *dict.fromkeys(others)]
    language = F.when(F.col(content).isNotNull(), language_of(F.col(path)))
    rows = files.select(*(F.col(c) for c in kept), language.alias("_language"), F.when(language.isNotNull(), F.col(content)).alias("_text"))
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(len(kept)).to_pylist()
            found = [first_error(text, language) if language else None for language, text in zip(told, batch.column(len(kept) + 1).to_pylist(), strict=True)]
            lines, messages = (pa.array([x and x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], lines, messages], names=[*kept, "language", "line_no", "message"])

    return rows.mapInArrow(judge, f"{kinds}, language string, line_no int, message string")


def parse_errors(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """(key, language, line_no, message) of the files that do not parse.

    Files with null content, a null path or another extension have no error. Empty content is judged like any other.
    Files are parsed where they are read: no shuffle. Extra columns are ignored.
    """
    return judged(files, key, path, content).where("message is not null")


def _files(spark, sf_dir: str, *others: str) -> DataFrame:
    """(file_id, others, language, line_no, message) of the counting rows. Every row is judged where it is read, so only
    verdicts are shuffled to find those that count."""
    files = table(spark, sf_dir, "source_files").where("file_id is not null")
    each = judged(spread(files.select("file_id", "repo", "file_path", "content", "rev")), "file_id", "file_path", "content", "rev", *others)
    told = [*others, "language", "line_no", "message"]
    last = F.max_by(F.struct(*told), F.coalesce("rev", F.lit(-(2**31)))).alias("r")
    return each.groupBy("file_id").agg(last).select("file_id", *(F.col(f"r.{c}").alias(c) for c in told))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The files whose counting row doesn't parse."""
    return _files(spark, sf_dir).where("message is not null").select("file_id")


def p2_errors(spark, sf_dir: str) -> DataFrame:
    """The first error of each file that doesn't parse."""
    return _files(spark, sf_dir).where("message is not null")


def p2_rates(spark, sf_dir: str) -> DataFrame:
    """Per repository and language: files with content, those that do not parse, and their share."""
    rates = _files(spark, sf_dir, "repo").where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("message").alias("failing"))
    return rates.withColumn("rate", F.round(F.col("failing") / F.col("files"), 6))
