"""Hold queries against their SQL: ``python tests/compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def cell(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    return x


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of rows, and what differs."""
    said = con.execute(sql)
    names = [d[0] for d in said.description]
    theirs = [dict(zip(names, r)) for r in said.fetchall()]
    if sorted(names) != sorted(df.columns):
        return 0, [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    ours = Counter(tuple(cell(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(cell(r[c]) for c in order) for r in theirs)
    more, less = ours - want, want - ours
    out = [f"{sum(more.values())} rows only here, {sum(less.values())} only in SQL; e.g. {list(more)[:2]} / {list(less)[:2]}"] if more or less else []
    return sum(ours.values()), out


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf, *names = sys.argv[1:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CORES', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = oracle(sf), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            rows, wrong = differences(queries[name](spark, sf), con, sql[name]) if name in sql else (queries[name](spark, sf).count(), ["no SQL"])
        except Exception as e:
            rows, wrong = 0, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += wrong not in ([], ["no SQL"])
        print(f"{name}: {rows} rows, {time.time() - began:.1f} s {'; '.join(wrong) or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
