"""Command line: ``dry [paths]`` and ``dry explain A B``."""

from __future__ import annotations

import argparse
import sys

from twinspan.plans import check, report
from twinspan.sources.documents import setting
from twinspan.sources.git import GitError


def _number(key: str):  # noqa: ANN202
    def read(text: str) -> float | int:
        value = setting(key, text)
        if value is None:
            raise argparse.ArgumentTypeError(f"bad value {text!r}")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinspan dry", description="Find duplicated structure and judge it.")
    p.add_argument("paths", nargs="*", help="report findings at or under these paths only; or: explain A B")
    p.add_argument("--base", help="compare with the merge base of this revision")
    p.add_argument("--threshold", type=_number("threshold"))
    p.add_argument("--min-lines", type=_number("min-lines"))
    p.add_argument("--min-nodes", type=_number("min-nodes"))
    p.add_argument("--format", choices=sorted(report.RENDERERS), default="text")
    p.add_argument("--include-tests", action="store_true")
    p.add_argument("--introduced-only", action="store_true")
    p.add_argument("--contract", default="contract")
    p.add_argument("--cache")
    p.add_argument("--root", default=".")
    p.add_argument("-v", "--version", action="version", version=report.VERSION)
    return p


def main(args: list[str] | None = None, spark=None, out=None) -> int:  # noqa: ANN001
    """Run the command; 0 clean, 1 failing, 2 not done."""
    out = out or sys.stdout
    try:
        given = parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    overrides = {}
    if given.threshold is not None:
        overrides["threshold"] = round(given.threshold * 1_000_000)
    if given.min_lines is not None:
        overrides["min_lines"] = given.min_lines
    if given.min_nodes is not None:
        overrides["min_nodes"] = given.min_nodes
    if spark is None:
        from twinspan.session import local_session

        spark = local_session()
    explaining = given.paths[:1] == ["explain"]
    options = check.Options(given.root, given.base, [] if explaining else given.paths, overrides, given.include_tests, given.introduced_only, given.contract, given.cache)
    try:
        if explaining:
            if len(given.paths) != 3:
                raise check.UsageError("explain takes two units")
            out.write(check.explain(spark, options, *given.paths[1:]))
            return 0
        result = check.run(spark, options)
    except (check.UsageError, GitError) as e:
        print(f"twinspan: {e}", file=sys.stderr)
        return 2
    out.write(report.render(result, given.format))
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
