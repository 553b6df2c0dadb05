"""Broken references, however skewed."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import orphans as o


def refs(spark, rows):
    df = spark.createDataFrame(rows, "id long, a long, b long, target string, key long")
    return o.references(df.drop("target", "key"), "t", {"a": "x", "b": "y"}, period=F.lit("2025-01"))


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def valid(spark, x, y, dead=()):
    tomb = spark.createDataFrame(list(dead), "table_name string, row_id long, deleted_at string")
    return o.targets({"x": [ids(spark, x)], "y": [ids(spark, y)]}, tomb)


def rows_of(df):
    return {(r.field_name, r.row_id) for r in df.collect()}


def test_nulls_tombstones_and_repeats(spark):
    r = refs(spark, [(1, 10, 20, "c", 1), (1, 10, 20, "c", 1), (2, None, 21, "c", 1), (3, 11, None, "c", 1), (4, 12, 20, "c", 1)])
    assert rows_of(o.orphan_rows(r, valid(spark, [10, 11], [20], [("x", 11, "d"), ("y", 10, "d")]))) == {("b", 2), ("a", 3), ("a", 4)}


def test_hot_key_missing_and_present(spark):
    data = [(i, 1 if i % 3 else 2, 100 + i, "c", 0) for i in range(600)]
    r = refs(spark, data)
    want = {("a", i) for i in range(600) if i % 3} | {("b", i) for i in range(600) if i >= 300}
    for parts in (1, 4, 2048):
        assert rows_of(o.orphan_rows(r, valid(spark, [2], range(100, 400)), parts)) == want


def test_many_missing_keys(spark):
    r = refs(spark, [(i, i % 7, i, "c", 0) for i in range(70)])
    got = rows_of(o.orphan_rows(r, valid(spark, [0, 1], range(10)), 10))
    assert got == {("a", i) for i in range(70) if i % 7 > 1} | {("b", i) for i in range(10, 70)}


def test_counts_and_empty(spark):
    r = refs(spark, [(1, 10, 20, "c", 1), (2, 10, 21, "c", 1), (3, 9, None, "c", 1)])
    got = {(x.field_name, x.period, x.n_refs, x.n_orphans) for x in o.orphan_counts(r, valid(spark, [10], [20])).collect()}
    assert got == {("a", "2025-01", 3, 1), ("b", "2025-01", 2, 1)}
    none = refs(spark, [])
    assert o.orphan_rows(none, valid(spark, [], [])).count() == 0
    assert rows_of(o.orphan_rows(refs(spark, [(1, 1, None, "c", 1)]), valid(spark, [], []))) == {("a", 1)}
