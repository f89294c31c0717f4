import pyarrow as pa

from twinspan.sources import units

RUBY = "class A\n  def f(x)\n    y = [" + ", ".join(f"x.m{k}({k})" for k in range(40)) + "]\n    y\n  end\n\n  def g\n    1\n  end\nend\n"
ERB = '<div class="a">\n  <% if x %>\n    <%= f(x) %>\n  <% end %>\n</div>\n'


def files(n):
    texts = [("a.rb", "ruby", RUBY), ("b.erb", "erb", ERB), ("bad.rb", "ruby", "def f(\n"), ("c.py", "python", "x"), ("d.rb", "ruby", None)]
    rows = [(f"{k}", *texts[k % len(texts)]) for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["k", "p", "l", "t"])


def test_batches_hold_few_nodes():
    """However many files come at once: all their trees at once took gigabytes of an executor's memory."""
    got = list(units.unit_batches([files(2000)]))
    held = [len(b.column("nodes").flatten()) for b in got]
    assert sum(held) > 3 * units._PIECE and max(held) < units._PIECE + 300 and max(b.num_rows for b in got) <= units._ROWS
    rows = [r for b in got for r in b.to_pylist()]
    assert len(rows) == 400 * (2 + 1 + 1) and [r["file_key"] for r in rows[:5]] == ["0", "0", "1", "2", "5"]
    assert rows[:4] == [r for b in units.unit_batches([files(5)]) for r in b.to_pylist()]


def test_batches_without_trees():
    with_trees = [r for b in units.unit_batches([files(5)]) for r in b.to_pylist()]
    without = [r for b in units.unit_batches([files(5)], trees=False) for r in b.to_pylist()]
    assert [{k: v for k, v in r.items() if k != "nodes"} for r in with_trees] == without
    assert [(r["identity"], r["error_line"], r["nodes"] and r["nodes"][0]["size"] == len(r["nodes"])) for r in with_trees] == [("A#f", None, True), ("A#g", None, True), ("b.erb", None, True), (None, 2, None)]


def test_read_units(spark):
    rows = spark.createDataFrame([("1", "a.rb", "ruby", RUBY), ("2", "bad.rb", "ruby", "def f(\n")], "k string, p string, l string, t string")
    found = units.read_units(rows, "k", "p", "l", "t").select("file_key", "identity", "error_line", "nodes.size", "nodes.child_digests").orderBy("file_key", "unit_no").collect()
    assert [(r[0], r[1], r[2], r[3] and r[3][0], r[4] and len(r[4][0])) for r in found] == [("1", "A#f", None, len(found[0][3]), 2), ("1", "A#g", None, 3, 1), ("2", None, 2, None, None)]
    bare = units.read_units(rows, "k", "p", "l", "t", trees=False)
    assert "nodes" not in bare.columns and bare.count() == 3


def test_units_in_order_shuffle_no_tree(spark, tmp_path):
    """Numbers as a join gives them, which shuffled and wrote all trees twice more."""
    from pyspark.sql import functions as F

    from twinspan.work import Workspace

    texts = [(f"app/{k % 7}/f{k}.rb", "ruby", "def f(\n" if k % 5 == 0 else RUBY if k % 3 else "x = 1\n") for k in range(60)] + [("app/t.erb", "erb", ERB)]
    rows = spark.createDataFrame(texts, "path string, language string, text string").repartition(3)
    work = Workspace(spark, "order")
    listed, nodes, errors = units.units_in_order(rows, work)
    old = units.read_units(rows, "path", "path", "language", "text")
    paths = rows.select(F.col("path").alias("file_key"), "path")
    own = units.numbered_units(old, paths, work)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, own.select(listed.columns).collect()))
    assert sorted(map(repr, nodes.collect())) == sorted(map(repr, units.unit_nodes(own).collect()))
    assert sorted(map(tuple, errors.collect())) == sorted(map(tuple, units.unit_errors(old, paths).collect())) and errors.count() == 12
