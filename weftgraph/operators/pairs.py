"""Pairs of the items of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable, sized

#: Items of a group up to which its pairs are made in one row.
BLOCK = 512


def array_pairs(items: str) -> Column:
    """Pairs ``a < b`` of a sorted array of distinct items."""
    xs = F.col(items)
    return F.flatten(F.transform(xs, lambda x, i: F.transform(F.slice(xs, i + 2, F.size(xs)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def group_pairs(rows: DataFrame, keys: list[str], item: str, block: int = BLOCK, only: DataFrame | None = None) -> DataFrame:
    """``*keys, a, b`` with a < b: every pair of distinct items of each group once.

    ``rows`` has ``*keys, item`` without nulls; repeats count once.  Groups of up to ``block`` rows
    are joined with themselves.  The distinct items of a larger
    group are dealt to parts of about half a block by hash, and each pair of parts is a
    row of its own: no task and no row gets a group, however large.  ``only`` has the keys
    (or some of them) of the groups that count.
    """
    counted = lambda df: df if only is None else df.join(only, only.columns, "left_semi")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > block).select(*keys)
    large = None if sizes.isEmpty() else durable(counted(sizes), "large")
    n_large = 0 if large is None else large.count()
    small = rows if large is None else rows.join(sizes, keys, "left_anti")
    # one exchange serves the distinct rows and both sides; no key has more than block rows here
    by = keys if only is None else only.columns
    base = counted(small.select(*keys, item).repartition(*by).distinct())
    left = base.select(*keys, F.col(item).alias("a"))
    right = base.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(item).alias("b"))
    on = [F.col(k) == F.col(f"_{k}") for k in by]
    pairs = left.join(right, on).where(F.col("a") < F.col("b"))
    for k in keys:
        pairs = pairs if k in by else pairs.where(F.col(k) == F.col(f"_{k}"))
    pairs = pairs.select(*keys, "a", "b")
    if n_large == 0:
        return pairs
    items = durable(rows.join(sized(large, n_large), keys).select(*keys, item).distinct(), "items")
    parts = sized(durable(items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, block // 2))).cast("int").alias("_parts")), "parts"), n_large)
    dealt = items.join(parts, keys).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int")).select(*keys, item, "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    first = F.col("_own") == F.least("_own", "_other")
    met = dealt.groupBy(*keys, F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q")).agg(F.collect_list(F.when(first, F.col(item))).alias("_left"), F.collect_list(F.when(~first, F.col(item))).alias("_right"))
    across = F.flatten(F.transform("_left", lambda x: F.transform("_right", lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    within = met.where("_p = _q").select(*keys, F.sort_array("_left").alias("_items")).select(*keys, F.inline(array_pairs("_items")))
    return pairs.unionByName(within).unionByName(met.where("_p < _q").select(*keys, F.inline(across)))
