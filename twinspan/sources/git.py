"""Revisions of a git repository as tables: listings, blobs, changed lines and line times.

Listings and diffs are metadata and are read by the driver; blobs and blame are read by the executors, a git process per
partition or file.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Settings that make git's output the same whatever a user's own are.
SETTINGS = {
    "core.quotepath": "off",
    "diff.renames": "true",
    "diff.noprefix": "false",
    "diff.mnemonicPrefix": "false",
    "diff.relative": "false",
    "diff.indentHeuristic": "false",
    "diff.interHunkContext": "0",
    "blame.ignoreRevsFile": "",
    "blame.markIgnoredLines": "false",
    "blame.markUnblamableLines": "false",
    "color.ui": "false",
}
PINNED = tuple(x for key, value in SETTINGS.items() for x in ("-c", f"{key}={value}"))
DIFF = ("--relative", "--unified=0", "--no-color", "--no-ext-diff", "--no-textconv", "--find-renames", "--diff-algorithm=myers", "--src-prefix=a/", "--dst-prefix=b/")
DEFAULT_BRANCHES = ("origin/main", "origin/master", "main", "master")
_HUNK = re.compile(rb"^@@ -\S+ \+(\d+)(?:,(\d+))? @@")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)")
_ESCAPES = {b"a": b"\a", b"b": b"\b", b"t": b"\t", b"n": b"\n", b"v": b"\v", b"f": b"\f", b"r": b"\r"}


class GitError(RuntimeError):
    """git failed."""


def run(root: str, *args: str, feed: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", root, *PINNED, *args], input=feed, capture_output=True, env=os.environ | {"LC_ALL": "C"}, check=False)
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def is_repository(root: str) -> bool:
    try:
        return run(root, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except (GitError, OSError):
        return False


def resolve(root: str, ref: str) -> str | None:
    """The commit a name stands for, or None."""
    try:
        return run(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip() or None
    except GitError:
        return None


def default_branch(root: str) -> str | None:
    """origin's HEAD, if it points to something, else the first of the usual names that exists."""
    try:
        named = [run(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").decode().strip()]
    except GitError:
        named = []
    return next((b for b in (*named, *DEFAULT_BRANCHES) if resolve(root, b)), None)


def prefix(root: str) -> str:
    """Where the folder lies in its repository, as "app/"; empty at the top. All paths here are relative to the folder."""
    return os.fsdecode(run(root, "rev-parse", "--show-prefix")).rstrip("\n")


def top(root: str) -> str:
    """The repository's own folder."""
    return os.fsdecode(run(root, "rev-parse", "--show-toplevel")).rstrip("\n")


def merge_base(root: str, ref: str) -> str | None:
    try:
        return run(root, "merge-base", ref, "HEAD").decode().strip() or None
    except GitError:
        return None


def is_sparse(root: str) -> bool:
    """Files of the commit may be missing from the work tree: by configuration, or as some are marked to be skipped."""
    try:
        if run(root, "config", "--bool", "core.sparseCheckout").strip() == b"true":
            return True
    except GitError:
        pass
    return any(row.startswith(b"S ") for row in run(root, "ls-files", "-t", "-z").split(b"\0"))


def head_files(root: str) -> list[str]:
    """Tracked files and untracked ones that aren't ignored; regular files only."""
    if is_sparse(root):
        raise GitError("a sparse checkout lacks files that the check needs")
    names = run(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split(b"\0")
    listed = sorted({os.fsdecode(n) for n in names if n})
    return [p for p in listed if os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p))]


def untracked_files(root: str) -> list[str]:
    names = run(root, "ls-files", "-z", "--others", "--exclude-standard").split(b"\0")
    return sorted(os.fsdecode(n) for n in names if n)


def files_at(root: str, commit: str) -> list[tuple[str, str]]:
    """(path, blob) of a commit's regular files under the folder; no symbolic links, no submodules."""
    out = []
    for row in run(root, "ls-tree", "-r", "-z", commit).split(b"\0"):
        if row:
            meta, _, path = row.partition(b"\t")
            mode, kind, blob = meta.split()[:3]
            if kind == b"blob" and mode != b"120000":
                out.append((os.fsdecode(path), blob.decode()))
    return sorted(out)


def read_blobs(root: str, blobs: list[str]) -> Iterator[bytes | None]:
    """Contents of blobs by one git process, in order; None where git has none."""
    data = run(root, "cat-file", "--batch", feed="".join(f"{b}\n" for b in blobs).encode())
    at = 0
    for _ in blobs:
        end = data.index(b"\n", at)
        head = data[at:end].split()
        if head[-1] == b"missing":
            yield None
            at = end + 1
        else:
            size = int(head[2])
            yield data[end + 1 : end + 1 + size]
            at = end + size + 2


def contents_at(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """(path, content BINARY) of a commit's files; each partition reads its blobs by one git process."""
    listing = spark.createDataFrame(files_at(root, commit), "path string, blob string")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = list(read_blobs(root, part["blob"].tolist()))
            yield pd.DataFrame({"path": part["path"], "content": found}).dropna()

    return listing.mapInPandas(read, "path string, content binary")


def _unquoted(name: bytes) -> bytes:
    if not name.startswith(b'"'):
        return name
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), name[1:-1])


def parse_diff(diff: bytes) -> list[tuple[str, int, int]]:
    """(path, from_line, to_line) of the lines that a diff without context adds or changes."""
    out: list[tuple[str, int, int]] = []
    path, header = None, False
    for line in diff.split(b"\n"):
        if line.startswith(b"diff --git "):
            path, header = None, True
        elif header and line.startswith(b"+++ "):
            name = _unquoted(line[4:].rstrip(b"\t"))
            path = None if name == b"/dev/null" else os.fsdecode(name[2:] if name.startswith(b"b/") else name)
        elif m := _HUNK.match(line):
            header = False
            start, count = int(m[1]), int(m[2]) if m[2] is not None else 1
            if path is not None and count:
                out.append((path, start, start + count - 1))
    return out


def changed_lines(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, from_line, to_line): lines changed since a commit, and all lines of untracked files. Of a file that was moved
    only the lines that changed with it count."""
    rows = parse_diff(run(root, "diff", *DIFF, base, "--"))
    for path in untracked_files(root):
        with open(os.path.join(root, path), "rb") as f:
            data = f.read()
        count = data.count(b"\n") + (not data.endswith(b"\n") and bool(data))
        if count:
            rows.append((path, 1, count))
    return spark.createDataFrame(rows, "path string, from_line int, to_line int")


def line_times(root: str, path: str) -> list[float]:
    """Commit time of each line, infinity where it isn't committed."""
    times: dict[str, float] = {}
    out, commit = [], ""
    for line in run(root, "blame", "--porcelain", "--no-ignore-revs-file", "--", path).split(b"\n"):
        if line.startswith(b"\t"):
            out.append(float("inf") if not commit.strip("0") else times[commit])
        elif m := re.match(rb"^([0-9a-f]{40,64}) \d+ \d+", line):
            commit = m[1].decode()
        elif line.startswith(b"committer-time "):
            times[commit] = float(line.split()[1])
    return out


def blame(paths: DataFrame, root: str) -> DataFrame:
    """(path, line, ts): commit times of every line of the paths; a file git doesn't know has infinite times. A git process
    per file, on the executors."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                try:
                    times = line_times(root, path)
                except GitError:
                    times = []
                    full = os.path.join(root, path)
                    if os.path.isfile(full):
                        with open(full, "rb") as f:
                            times = [float("inf")] * len(f.read().splitlines())
                yield pd.DataFrame({"path": path, "line": range(1, len(times) + 1), "ts": times})

    return paths.select("path").distinct().mapInPandas(read, "path string, line int, ts double")
