"""Only new or changed records are processed, and failures neither skip nor repeat any."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import incremental as inc

ART = "id long, workspace string, path string, kind string, sha string, ingested_at timestamp, run_id string"
ITEM = "run_id long, workspace string, path string, sha string, done_at timestamp"
RUN = "run_id long, started_at timestamp, finished_at timestamp, status string"


def at(day: int) -> dt.datetime:
    return dt.datetime(2025, 1, day)


def found(spark, artifacts, items, runs, upper=None):
    a = spark.createDataFrame(artifacts, ART)
    i = spark.createDataFrame(items, ITEM)
    r = spark.createDataFrame(runs, RUN)
    return {(x.artifact_id, x.reason) for x in inc.pending(a, i, r, upper).collect()}


def test_reasons_spellings_and_repeats(spark):
    artifacts = [
        (1, "w", "/a/b", "code", "AA", at(1), "clash"),
        (1, "w", "/a/b", "code", "AA", at(1), "clash"),
        (2, "w", "\\a\\.\\c", "code", "x2", at(2), None),
        (2, "w", "\\a\\.\\c", "code", "x1", at(1), None),
        (3, "w", "/a/d", "code", None, at(1), None),
        (4, "w", "/a/e", "code", "y", at(1), None),
        (5, "w", "/a/f", "code", "z", at(1), None),
        (6, None, "/a/g", "code", "z", at(1), None),
        (7, "w", None, "code", "z", at(1), None),
    ]
    items = [
        (1, "w", "/a//b", "aa", at(3)),
        (1, "w", "/a/c", "x1", at(3)),
        (1, "w", "/a/d", None, at(3)),
        (2, "w", "/a/e", "y", at(4)),
        (1, "w", "/a/f", "z", at(3)),
        (3, "w", "/a/f", "older", at(5)),
        (1, None, "/a/g", "z", at(3)),
    ]
    runs = [(1, at(3), at(3), "ok"), (2, at(4), at(4), "failed"), (3, at(5), at(5), "ok"), (4, at(6), None, "running")]
    want = {(2, "changed"), (3, "no_sha"), (4, "new"), (5, "changed"), (6, "new"), (7, "new")}
    assert found(spark, artifacts, items, runs) == want


def test_upper_bound_hides_later_commits(spark):
    artifacts = [(5, "w", "/a/f", "code", "z", at(1), None)]
    items = [(1, "w", "/a/f", "z", at(3)), (3, "w", "/a/f", "older", at(5))]
    runs = [(1, at(3), at(3), "ok"), (3, at(5), at(5), "ok")]
    assert found(spark, artifacts, items, runs, at(4)) == set()


def test_empty_tables(spark):
    assert found(spark, [], [], []) == set()
    assert found(spark, [(1, "w", "/a", "code", "s", at(1), None)], [], []) == {(1, "new")}


def test_sink_survives_a_crash(spark, tmp_path):
    source = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    sink = inc.IncrementalSink(spark, str(tmp_path / "out"))
    first = sink.run(source.where("seq < 40"), "seq", lambda df: df)
    assert (first.low, first.high) == (None, 39)

    def crash(df):
        df.write.parquet(str(tmp_path / "out/data/half-done/rows"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        sink.run(source, "seq", crash)
    assert sink.watermark() == 39
    second = sink.run(source, "seq", lambda df: df, upper=70)
    assert (second.low, second.high) == (39, 70)
    sink.run(source, "seq", lambda df: df)
    assert sink.run(source, "seq", lambda df: df) is None
    rows = sorted(r.seq for r in sink.read().collect())
    assert rows == list(range(100))


def test_two_runs_cannot_both_commit(spark, tmp_path):
    source = spark.range(10).select(F.col("id").alias("seq"))
    sink = inc.IncrementalSink(spark, str(tmp_path / "out"))

    def overtaken(df):
        inc.IncrementalSink(spark, str(tmp_path / "out")).run(source, "seq", lambda x: x)
        return df

    with pytest.raises(Exception):
        sink.run(source, "seq", overtaken)
    assert sorted(r.seq for r in sink.read().collect()) == list(range(10))


def test_nothing_to_do(spark, tmp_path):
    sink = inc.IncrementalSink(spark, str(tmp_path / "out"))
    assert sink.read() is None and sink.watermark() is None
    assert sink.run(spark.createDataFrame([], "seq long"), "seq", lambda df: df) is None


def test_steps_read_only_what_is_new_and_agree_with_all_at_once(spark, tmp_path):
    a = spark.createDataFrame([(k, "w", f"/f{k}", "code", f"s{k}", at(1), None) for k in range(6)], ART)
    items = [(1, "w", "/f0", "s0", at(3)), (1, "w", "/f1", "old", at(3)), (2, "w", "/f1", "s1", at(4)), (3, "w", "/f2", "s2", at(5)), (4, "w", "/f0", "other", at(6)), (9, "w", "/f3", "s3", at(6))]
    runs = [(1, at(3), at(3), "ok"), (2, at(4), at(4), "ok"), (3, at(5), at(5), "failed"), (4, at(6), at(6), "ok"), (9, at(6), None, "running")]
    sink = inc.IncrementalSink(spark, str(tmp_path / "out"))
    step = lambda i, r, upper=None: {(x.artifact_id, x.reason) for x in inc.step(sink, a, spark.createDataFrame(i, ITEM), spark.createDataFrame(r, RUN), upper).collect()}
    # bound fixed at day 4: the run that lands later is not seen
    assert step(items, runs, at(4)) == found(spark, [tuple(r) for r in a.collect()], items, runs, at(4)) == {(k, "new") for k in (2, 3, 4, 5)}
    assert sink.watermark() == 2
    # items of runs below the watermark are not read again: the state has them
    assert step(items[4:], runs) == found(spark, [tuple(r) for r in a.collect()], items, runs) == {(0, "changed"), (2, "new"), (3, "new"), (4, "new"), (5, "new")}
    assert sink.watermark() == 3 and sink.last().low == 2
    # nothing new, the same answer
    assert step([], runs) == {(0, "changed"), (2, "new"), (3, "new"), (4, "new"), (5, "new")}
    # a run that turns up below the watermark shifts the numbers: everything is folded again
    late = [*runs, (7, at(2), at(2), "ok")]
    assert step([*items, (7, "w", "/f4", "s4", at(2))], late) == {(0, "changed"), (2, "new"), (3, "new"), (5, "new")}
    assert sink.last().low == 0 and sink.watermark() == 4


def test_compaction(spark, tmp_path):
    sink = inc.IncrementalSink(spark, str(tmp_path / "out"))
    source = spark.range(30).select(F.col("id").alias("seq"))
    for upper in (9, 19):
        sink.run(source, "seq", lambda df: df, upper)
    sink.compact()
    assert len(sink.commits()) == 1 and sink.watermark() == 19
    sink.run(source, "seq", lambda df: df)
    assert len(sink.commits()) == 2 and sorted(r.seq for r in sink.read().collect()) == list(range(30))
