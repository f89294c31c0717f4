import tracemalloc

import pyarrow as pa

from twinspan.plans import catalog


def test_contents_are_shuffled_once_for_reading(spark, tmp_path):
    """Counting the pieces of the read files ran their shuffles, which then ran again."""
    rows = [(k, "r", f"app/f{k % 50}.rb", "ruby", "def f\nend\n", 1) for k in range(100)]
    spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, file_language string, content string, rev int").write.parquet(str(tmp_path / "source_files.parquet"))
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("snapshot", "")
    try:
        found = catalog.source_units(spark, str(tmp_path))
        assert len(status.getJobIdsForGroup("snapshot")) <= 1  # the scan's schema
        assert found.count() == 50
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_names_are_read_without_trees(spark, tmp_path):
    spark.createDataFrame([(1, "r", "app/a.rb", "ruby", "def f\nend\n", 1)], "file_id bigint, repo string, file_path string, file_language string, content string, rev int").write.parquet(str(tmp_path / "source_files.parquet"))
    spark.createDataFrame([(7, 1, "method", "Object#f", 1, 2, 1)], "entry_id bigint, file_id bigint, unit_kind string, unit_identity string, start_line int, end_line int, rev int").write.parquet(str(tmp_path / "entries.parquet"))
    found = catalog.source_names(spark, str(tmp_path))
    assert "child_digests" not in found._jdf.queryExecution().toString() and [tuple(r) for r in found.collect()] == [(7, "Object#f")]


def test_a_worker_holds_no_trees_for_names(spark, tmp_path, monkeypatch):
    """It held those of all files that came at once: a gigabyte. What waits to be collected as garbage is some 9 MB."""
    spark.createDataFrame([(1, "r", "app/a.rb", "ruby", "def f\nend\n", 1)], "file_id bigint, repo string, file_path string, file_language string, content string, rev int").write.parquet(str(tmp_path / "source_files.parquet"))
    spark.createDataFrame([(7, 1, "method", "Object#f", 1, 2, 1)], "entry_id bigint, file_id bigint, unit_kind string, unit_identity string, start_line int, end_line int, rev int").write.parquet(str(tmp_path / "entries.parquet"))
    frame, steps = type(spark.range(1)), []
    own = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, read, *rest, **named: steps.append(read) or own(self, read, *rest, **named))
    catalog.source_names(spark, str(tmp_path))
    text = "def f(x)\n  y = [" + ", ".join(f"x.m{k}({k})" for k in range(100)) + "]\n  y\nend\n"
    given = [pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*((f"r/{k}.rb", f"r/{k}.rb", "ruby", text) for k in range(n)), strict=True)], names=["_k", "_p", "_l", "_t"]) for n in (1, 300)]
    list(steps[0](iter(given[:1])))  # the grammars are made
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in steps[0](iter(given[1:])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 300 and peak < 16_000_000, peak
