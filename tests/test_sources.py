import json
import os
import subprocess

import pytest

from twinspan.plans import cache, report
from twinspan.sources import documents, files, git

MARKDOWN = """# Heading #
Some prose
here.

```parallel
A::B  # note
C#d
```
Title
=====
<!--
```parallel
Hidden
```
-->
~~~~ covers
~~~
X::Y
~~~~
``` not`fence
```settings
threshold: 0.9
"""


def test_blocks():
    found = documents.blocks(MARKDOWN)
    assert [(b.info, b.line, b.heading) for b in found] == [("parallel", 5, "Heading"), ("covers", 16, "Title"), ("settings", 21, "Title")]
    assert found[0].reason == "Heading Some prose here."
    assert [documents.without_note(t) for t, _ in found[0].body] == ["A::B", "C#d"]
    assert [t for t, _ in found[1].body] == ["~~~", "X::Y"] and [t for t, _ in found[2].body] == ["threshold: 0.9", ""]


def test_block_rows(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, ""), (4, "no blocks")], "id bigint, t string")
    rows = documents.block_rows(df, "id", "t").collect()
    assert [(r["id"], r["block_no"], r["lines"]) for r in rows] == [(1, 0, ["A::B", "C#d"]), (1, 1, ["~~~", "X::Y"]), (1, 2, ["threshold: 0.9"])]


def put(root, path, text, mode="w"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, mode) as f:
        f.write(text)


def test_contract(tmp_path):
    root = str(tmp_path)
    put(root, "contract/money/README.md", "```covers\nMoney::*\n```\n```settings\n```\n")
    put(root, "contract/money/duplication.md", "# Why\n```parallel\nA\nB\n```\n```settings\nthreshold: 0.6\nmin-lines: 0\nsize: 3\nthreshold: 0.7\nmin-nodes: 7\n```\n")
    put(root, "contract/money/duplication/x.md", "```parallel\n# nothing\n```\n```settings\n```\n```covers\nX\n```\n")
    put(root, "contract/money/notes.md", "```covers\nX\n```\n")
    put(root, "contract/top.md", "```parallel\nX\n```\n")
    put(root, "contract/money/bad.md", b"\xff", "wb")
    os.symlink(os.path.join(root, "contract/top.md"), os.path.join(root, "contract/link.md"))
    got = documents.load_contract(root)
    assert got.covers == [("money", "Money::*", "contract/money/README.md", 2)] and got.settings == {"money": {"threshold": 0.6, "min_nodes": 7}}
    assert [c["heading"] for c in got.clauses] == ["Why"] and got.clauses[0]["key"] == documents.clause_key("money", ["B", "A"])
    messages = " | ".join(e[2] for e in got.errors)
    for part in ("should be in duplication.md", 'min-lines can\'t be "0"', "no such setting: size", "threshold is set twice", "without references", "has settings already", "should be in README.md", "is neither in", "in no primitive's folder", "not UTF-8", "symbolic links"):
        assert part in messages
    assert documents.load_contract(root, "absent").clauses == []


def test_notes_and_headings():
    kept = {"#settle": "#settle", "Foo #bar": "Foo #bar", "Foo # bar": "Foo", "Foo #": "Foo", "# all": "", "#": "", "A#b  # c # d": "A#b", "A #x # y": "A #x", "  ": "", "\t#\tq": ""}
    assert {k: documents.without_note(k) for k in kept} == kept
    text = "# T\n---\nold prose\n\nTitle\n=====\nwhy one\n```ruby\ncode\n```\nwhy two\n```parallel\n#settle\nA # b\n```\n```covers\nX\n```\n## Shut ##\n---\n~~~~  settings  more\n~~~\n~~~~\n<!-- # Not\n```parallel\n```\n--> # Yes\n# #\n- - -\n```parallel\n```"
    got = documents.blocks(text)
    assert [(b.info, b.line, b.heading, b.reason) for b in got] == [
        ("ruby", 8, "Title", "Title why one"), ("parallel", 12, "Title", "Title why one why two"), ("covers", 16, "Title", "Title"), ("settings", 21, "Shut", "Shut ---"), ("parallel", 30, "", "- - -")
    ]
    assert [t for t, _ in got[1].body] == ["#settle", "A # b"] and [t for t, _ in got[3].body] == ["~~~"]


@pytest.fixture
def repository(tmp_path):
    root = str(tmp_path / "r")
    os.makedirs(root)

    def run(*args, when=1_700_000_000):
        subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": f"{when} +0000", "GIT_AUTHOR_DATE": f"{when} +0000"})

    run("init", "-q", "-b", "main")
    put(root, "a.rb", "one\ntwo\nthree\n")
    put(root, "sub/café.rb", "x\n")
    put(root, ".gitignore", "ignored.rb\n")
    os.symlink("a.rb", os.path.join(root, "link.rb"))
    run("add", "-A")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "work")
    put(root, "a.rb", "one\nTWO\nthree\nfour\n")
    run("commit", "-qam", "two", when=1_700_000_500)
    put(root, "new.rb", "p\nq")
    put(root, "ignored.rb", "z")
    put(root, "sub/café.rb", "x\ny\n")
    return root


def test_git(spark, repository):
    assert git.is_repository(repository) and not git.is_repository("/") and git.default_branch(repository) == "main"
    base = git.merge_base(repository, "main")
    assert base == git.resolve(repository, "main") and git.resolve(repository, "nope") is None
    assert git.head_files(repository) == [".gitignore", "a.rb", "new.rb", "sub/café.rb"]
    assert [p for p, _ in git.files_at(repository, base)] == [".gitignore", "a.rb", "sub/café.rb"]
    assert {r["path"]: bytes(r["content"]) for r in git.contents_at(spark, repository, base).collect()}["a.rb"] == b"one\ntwo\nthree\n"
    assert list(git.read_blobs(repository, ["0" * 40])) == [None]
    assert {tuple(r) for r in git.changed_lines(spark, repository, base).collect()} == {("a.rb", 2, 2), ("a.rb", 4, 4), ("new.rb", 1, 2), ("sub/café.rb", 2, 2)}
    times = {(r["path"], r["line"]): r["ts"] for r in git.blame(spark.createDataFrame([("a.rb",), ("new.rb",), ("gone.rb",)], "path string"), repository).collect()}
    assert times["a.rb", 1] == 1_700_000_000 and times["a.rb", 2] == 1_700_000_500 and times["new.rb", 1] == float("inf") and len(times) == 6


def test_git_in_a_folder_with_moves_and_hostile_settings(spark, repository):
    """Paths are relative to the folder, moves touch what changed, and a user's settings change nothing."""

    def run(*args):
        subprocess.run(["git", "-C", repository, "-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)

    put(repository, "sub/long.rb", "".join(f"line {k}\n" for k in range(40)))
    run("add", "-A")
    run("commit", "-qm", "three")
    base = git.resolve(repository, "HEAD")
    run("mv", "sub/long.rb", "sub/moved.rb")
    put(repository, "sub/moved.rb", "".join(f"line {k}\n" for k in range(39)) + "changed\n")
    put(repository, "sub/café.rb", "x\nz\n")
    run("add", "-A")
    run("commit", "-qm", "four")
    put(repository, "ignored-revs", f"{git.resolve(repository, 'HEAD')}\n")
    expected = {("moved.rb", 40, 40), ("café.rb", 2, 2)}
    folder = os.path.join(repository, "sub")
    before = git.line_times(folder, "café.rb")
    for key, value in {"diff.renames": "false", "diff.noprefix": "true", "diff.mnemonicPrefix": "true", "core.quotepath": "true", "diff.interHunkContext": "50", "diff.external": "/bin/false", "diff.algorithm": "patience", "blame.ignoreRevsFile": "ignored-revs", "blame.markIgnoredLines": "true", "color.ui": "always", "diff.relative": "true"}.items():
        run("config", key, value)
    assert git.prefix(folder) == "sub/" and git.prefix(repository) == "" and git.top(folder) == os.path.realpath(repository)
    assert git.head_files(folder) == ["café.rb", "moved.rb"]
    assert [p for p, _ in git.files_at(folder, base)] == ["café.rb", "long.rb"]
    assert {tuple(r) for r in git.changed_lines(spark, folder, base).collect()} == expected
    assert git.line_times(folder, "café.rb") == before


def test_skipped_files_are_sparse(repository):
    assert not git.is_sparse(repository)
    subprocess.run(["git", "-C", repository, "update-index", "--skip-worktree", "a.rb"], check=True)
    assert git.is_sparse(repository)
    with pytest.raises(git.GitError):
        git.head_files(repository)


def test_files(spark, tmp_path):
    root = str(tmp_path)
    put(root, "app/a.rb", "x\n")
    put(root, "app/b.rb", "# do not edit\n")
    put(root, "vendor/c.rb", "x")
    put(root, "spec/d_spec.rb", "x")
    put(root, "app/e.rb", b"ok\n\xff\n", "wb")
    os.symlink(os.path.join(root, "app"), os.path.join(root, "linked"))
    assert files.walked(root) == ["app/a.rb", "app/b.rb", "app/e.rb", "spec/d_spec.rb", "vendor/c.rb"]
    assert files.linked(root, "linked/a.rb") and not files.linked(root, "app/a.rb")
    read = files.read_files(spark, root, [*files.walked(root), "missing.rb", "linked/a.rb"])
    good, bad = files.decoded(read)
    assert {r["path"] for r in good.collect()} == {"app/a.rb", "app/b.rb", "vendor/c.rb", "spec/d_spec.rb"}
    assert [tuple(r) for r in bad.collect()] == [("app/e.rb", 2, "file is not valid UTF-8")]
    assert {r["path"] for r in files.source_files(good, content="text").collect()} == {"app/a.rb"}
    assert {r["path"] for r in files.source_files(good, include_tests=True, content="text").collect()} == {"app/a.rb", "spec/d_spec.rb"}


def test_cache(spark, tmp_path):
    rows = {"clusters": [("k", 1)], "structures": [("s", 1)], "pairs": [("a", "b", "s", "t", 0.5, "x", "y")], "clauses": [("c",)]}
    tables = {n: spark.createDataFrame(r, cache.SCHEMAS[n]) for n, r in rows.items()}
    key = cache.cache_key("sha", 2, False, "", "contract")
    assert key != cache.cache_key("sha", 2, True, "", "contract")
    assert cache.read(spark, str(tmp_path), key) is None
    assert cache.write(tables, str(tmp_path), key)
    assert {n: [tuple(r) for r in t.collect()] for n, t in cache.read(spark, str(tmp_path), key).items()} == rows
    broken = tables | {"clauses": spark.createDataFrame([(1,)], "key int").selectExpr("cast(raise_error('no') as string) as key")}
    assert not cache.write(broken, str(tmp_path), "other")
    assert cache.write(tables, str(tmp_path), key)
    assert os.listdir(tmp_path) == [key]
    subprocess.run(["rm", "-r", str(tmp_path / key / "pairs")], check=True)
    assert cache.read(spark, str(tmp_path), key) is None


def test_reports():
    place = report.Place("app/models/a.rb", 1, 9, "A#x", 30, touched=True)
    other = report.Place("app/models/longer.rb", 11, 19, "B#yy", 31)
    found = report.Finding("introduced", "method", 0.87654321, place, [(other, 0.87654321), (other, 0.8)], "call or extend B#yy", 26.1)
    result = report.Result([found], contracted=[(f"a{k}", "b", 0.5) for k in range(22)], clause_errors=[("c.md", 3, "stale")], notes=["n"], base="0123456789", exit_code=1)
    said = report.render(result, "text")
    assert said.startswith("dry: 1 introduced, 22 contracted, 1 contract error   base 0123456\nnote: n\n\nINTRODUCED  0.88  method\n")
    assert "  new       app/models/a.rb:1-9         A#x\n  existing  app/models/longer.rb:11-19  B#yy  0.88\n" in said and "  and 2 more\n" in said
    assert json.loads(report.render(result, "json"))["counts"] == {"introduced": 1, "kept": 0, "contracted": 22}
    assert report.render(result, "edn").count(":score 0.87654321") == 1
    odd = report.Result([report.Finding("found", "method", 1.0, report.Place('a"b\\c.rb', 1, 2, "A", 3), [(other, 1.0)], "h", 1.0)])
    assert ':file "a\\"b\\\\c.rb",' in report.render(odd, "edn")
    assert report.render(report.Result(), "text") == "dry: clean\n"
    with pytest.raises(ValueError):
        report.render(result, "xml")
