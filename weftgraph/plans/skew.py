"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable

#: A key is heavy if it holds more than one row in so many; there are fewer heavy keys than this.
HEAVY_PARTS = 2048


def heavy_keys(df: DataFrame, keys: list[str], parts: int = HEAVY_PARTS, total: int | None = None) -> DataFrame:
    """Keys with more than ``1/parts`` of all rows of ``df``: fewer than ``parts`` rows, written once.

    Counts are partial before the shuffle, so a hot key sends one row per task.  Rows
    with a null in any key have no heavy key (they match nothing in a join).
    """
    total = df.count() if total is None else total
    counted = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return durable(counted.where(F.col("_n") * parts > F.lit(total)).select(*keys), "heavy")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", parts: int = HEAVY_PARTS, heavy: DataFrame | None = None) -> DataFrame:
    """Equi-join that sends only the light keys of ``left`` through a shuffle.

    ``right`` must have at most one row per key.  Its rows for the heavy keys, fewer
    than ``parts``, are broadcast; all other rows join by shuffle.  The result equals
    ``left.join(right, keys, how)`` for ``how`` in inner, left, left_semi, left_anti.
    """
    heavy = heavy_keys(left, keys, parts) if heavy is None else heavy
    flag = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    marked = left.join(flag, keys, "left")
    hot = marked.where("_heavy").drop("_heavy")
    cold = marked.where("_heavy is null").drop("_heavy")
    right_hot = right.join(F.broadcast(heavy), keys, "left_semi")
    joined = hot.join(F.broadcast(right_hot), keys, how).unionByName(cold.join(right, keys, how))
    return joined
