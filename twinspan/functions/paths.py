"""Rules on paths and file headers: what is source, in which language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First path segments that hold no source of one's own.
EXCLUDED_ROOTS = ("vendor", "node_modules", "tmp", "log", "coverage", "public", "storage", "bin")
#: A generator's marks at the beginning of a comment in a file's first five lines.
GENERATED = r"(?i)^\s*(?:<%#|#|//)\s*(?:this file is auto-?generated|this file is automatically generated|auto-?generated by|generated by\b.*\bdo not edit|do not edit|code generated\b.*\bdo not edit)"
#: How much of a file its first five lines are looked for in.
HEADER = 64 * 1024


def language(path: Column) -> Column:
    """ruby, erb, or null for what is neither."""
    return F.when(path.rlike(r"\.rb$"), "ruby").when(path.rlike(r"\.(?:html(?:\+[\w-]+)?|turbo_stream)\.erb$"), "erb")


def allowed(path: Column) -> Column:
    """Not hidden, not third-party, not schema, migrations, settings or built assets."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda x: x.startswith("."))
    settings = path.rlike(r"^(?:(?:engines|packs|components|gems)/[^/]+/)?(?:db|config)/")
    return ~hidden & ~F.element_at(parts, 1).isin(*EXCLUDED_ROOTS) & ~settings & ~path.startswith("app/assets/builds/")


def is_test(path: Column) -> Column:
    """In a directory spec or test, or named like a test."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(F.lit("spec"), F.lit("test"))) | path.rlike(r"_(?:spec|test)\.rb$")


def generated(content: Column) -> Column:
    """A generator's header in the first five lines; null content has none."""
    lines = F.slice(F.split(F.substring(content, 1, HEADER), "\n"), 1, 5)
    return F.coalesce(F.exists(lines, lambda x: x.rlike(GENERATED)), F.lit(False))


def snake_case(text: Column) -> Column:
    """CamelCase to snake_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
