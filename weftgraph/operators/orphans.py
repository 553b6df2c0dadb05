"""References to records that do not exist.

References are rows ``table_name, field_name, row_id, target, key, period``; targets are
rows ``target, key``.  A reference is an orphan if its key is not null and no target row
has it.  The check runs on aggregated keys, so it costs one row per distinct key and task
however often a key is used:

1. references are counted per target and key (partial before the shuffle);
2. the few heavy keys are broadcast and looked up among the targets where those lie;
3. the remaining keys go through a shuffled anti join, one row per key;
4. both sets of missing keys lead back to the rows, or to counts per field and period.

Nothing but the heavy keys, fewer than ``HEAVY_PARTS`` rows, is broadcast by this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable, kept
from weftgraph.plans.skew import HEAVY_PARTS

KEY = ["target", "key"]


def references(df: DataFrame, table_name: str, fields: dict[str, str], row_id: str = "id", period: Column | None = None) -> DataFrame:
    """Reference rows of a table; ``fields`` maps a field to the target it points at.  Null keys are left out."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("target"), F.col(f).cast("long").alias("key")) for f, t in fields.items()])
    return df.select(F.lit(table_name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), (F.lit(None).cast("string") if period is None else period).alias("period"), F.inline(entries)).where("key is not null")


def targets(existing: dict[str, list[DataFrame]], tombstones: DataFrame | None = None, id_column: str = "id") -> DataFrame:
    """Rows ``target, key`` that exist: ids of the tables of a target without its tombstones.

    Repeats are harmless.  Tombstones name their target in ``table_name``.
    """
    parts = [df.select(F.lit(t).alias("target"), F.col(id_column).cast("long").alias("key")) for t, dfs in existing.items() for df in dfs]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    ids = ids.where("key is not null")
    if tombstones is None:
        return ids
    dead = tombstones.select(F.col("table_name").alias("target"), F.col("row_id").cast("long").alias("key")).where("key is not null").distinct()
    return ids.join(dead, KEY, "left_anti")


def missing_keys(refs: DataFrame, valid: DataFrame, parts: int = HEAVY_PARTS) -> tuple[DataFrame, DataFrame]:
    """Keys that references use and no target has, ``target, key``, and the heavy keys, ``target, key, gone``; durable.

    A key is heavy if it holds more than ``1/parts`` of all references, so there are fewer than
    ``parts`` heavy ones; ``gone`` tells whether they are missing.
    """
    keys = durable(refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_refs")), "keys")
    total = keys.agg(F.sum("n_refs")).first()[0] or 0
    is_heavy = F.col("n_refs") * parts > F.lit(total)
    hot = keys.where(is_heavy).select(*KEY)
    present = valid.join(F.broadcast(hot), KEY, "left_semi").distinct().withColumn("there", F.lit(True))
    heavy = durable(hot.join(F.broadcast(present), KEY, "left").select(*KEY, F.col("there").isNull().alias("gone")), "heavy")
    light = keys.where(~is_heavy).select(*KEY).join(valid, KEY, "left_anti")
    return durable(heavy.where("gone").select(*KEY).unionByName(light), "missing"), heavy


@kept("orphans")
def orphan_rows(refs: DataFrame, valid: DataFrame, parts: int = HEAVY_PARTS) -> DataFrame:
    """``table_name, field_name, row_id``, distinct: every reference that leads nowhere.

    References with a heavy key are judged by broadcast, whether it is missing or there; only
    the others are shuffled to meet the missing keys.
    Null keys are no references; a row delivered twice counts once; an empty target
    table makes every reference an orphan; without references the result is empty.
    """
    missing, heavy = missing_keys(refs, valid, parts)
    marked = refs.join(F.broadcast(heavy), KEY, "left")
    hit = marked.where("gone").drop("gone").unionByName(marked.where("gone is null").drop("gone").join(missing, KEY, "left_semi"))
    return hit.select("table_name", "field_name", "row_id").distinct()


@kept("orphan_counts")
def orphan_counts(refs: DataFrame, valid: DataFrame, parts: int = HEAVY_PARTS) -> DataFrame:
    """``table_name, field_name, period, n_refs, n_orphans``: all and broken references per field and period.

    References are first aggregated per field, period and key, so what meets the missing
    keys has one row for each such group.  A null period stands for "unknown".
    """
    per_key = durable(refs.groupBy("table_name", "field_name", "period", *KEY).agg(F.count(F.lit(1)).alias("n")), "per_key")
    missing, _ = missing_keys(refs, valid, parts)
    return (
        per_key.join(missing.withColumn("gone", F.lit(1)), KEY, "left")
        .groupBy("table_name", "field_name", "period")
        .agg(F.sum("n").alias("n_refs"), F.sum(F.when(F.col("gone") == 1, F.col("n")).otherwise(0)).alias("n_orphans"))
    )
