"""Entity resolution: which entities are one, and folding them into one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.plans.durable import drop_durable, durable, kept
from weftgraph.plans.skew import heavy_keys, split_join


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``entities`` (distinct ids) with ``n_mentions``, 0 for those nobody mentions."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_mentions"))
    return entities.join(counts, "id", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))


def alias_buckets(entities: DataFrame, mentions: DataFrame, etype: str | None = None) -> DataFrame:
    """``workspace, etype, key, id, name, canonical_id, bucket_size`` of entities whose names are equal but for case, article and punctuation.

    Only buckets of two or more entities of one workspace and type appear.  The canonical
    one has most mentions, then the longest name, then the smallest id.  Names that are
    null or only punctuation have no bucket.  The bucket is never gathered: its best row and
    size are aggregated and joined back, hot buckets by broadcast.
    """
    rows = entities.select("workspace", "id", "name", "etype").where("id is not null").distinct()
    if etype is not None:
        rows = rows.where(F.col("etype") == etype)
    keyed = mention_counts(rows, mentions).withColumn("key", T.entity_key(F.col("name"))).where("key <> ''").withColumn("_type", F.coalesce("etype", F.lit("")))
    keyed = durable(keyed, "keyed")
    on = ["workspace", "_type", "key"]
    best = keyed.groupBy(*on).agg(F.max(F.struct("n_mentions", F.length("name").alias("l"), (-F.col("id")).alias("i"), F.col("id").alias("id"))).alias("m"), F.count(F.lit(1)).alias("bucket_size")).where("bucket_size > 1")
    best = best.select(*on, F.col("m.id").alias("canonical_id"), "bucket_size")
    return split_join(keyed, best, on).select("workspace", "etype", "key", "id", "name", "canonical_id", "bucket_size")


def _near(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Pairs of one pair of blocks: rows ``scope, p, q, right, id, v`` of unit vectors."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        vectors = table.column("v").combine_chunks()
        width = len(vectors[0].as_py()) if len(vectors) else 0
        data = vectors.flatten().to_numpy().reshape(len(vectors), width)
        same = key[1].as_py() == key[2].as_py()
        a, b = (np.flatnonzero(~right), np.flatnonzero(~right if same else right))
        s = data[a] @ data[b].T
        i, j = np.nonzero(s >= threshold)
        if same:
            i, j = i[ids[a[i]] < ids[b[j]]], j[ids[a[i]] < ids[b[j]]]
        x, y = ids[a[i]], ids[b[j]]
        return pa.table({"scope": pa.array([key[0].as_py()] * len(i), pa.string()), "a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": s[i, j]})

    return work


def similar_pairs(vectors: DataFrame, threshold: float = 0.9, block: int = 512) -> DataFrame:
    """``scope, a, b, similarity`` of vectors of one scope with a cosine of at least ``threshold``; a < b.

    ``vectors`` has ``scope, id, vector``.  Exact, so the work is quadratic within a scope:
    vectors are dealt to blocks of some ``block`` rows, and each pair of blocks is one
    group of bounded size, compared by one product of matrices, which spreads a scope over
    as many tasks as it has block pairs.  Null and empty vectors, vectors with null elements and null ids are left
    out; vectors of different length are not compared; a scope of null counts as empty.
    """
    scope = F.concat_ws("\n", F.coalesce("scope", F.lit("")), F.size("vector"))
    whole = "vector is not null and id is not null and size(vector) > 0 and not exists(vector, x -> x is null)"
    typed = vectors.where(whole).select(scope.alias("scope"), F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    rows = durable(typed.withColumn("norm", T.norm(F.col("v"))).select("scope", "id", F.transform("v", lambda x: x / F.col("norm")).alias("v")), "vectors")
    size = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(size, "scope").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    sent = dealt.select("scope", "id", "v", "own", F.explode(others).alias("o")).select("scope", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), (F.col("own") > F.col("o")).alias("right"), "id", "v")
    near = sent.groupBy("scope", "p", "q").applyInArrow(_near(threshold), "scope string, a long, b long, similarity double")
    return near.withColumn("scope", F.regexp_replace("scope", r"\n[0-9]+\z", ""))


@kept("groups")
def linked_groups(pairs: DataFrame) -> DataFrame:
    """``id, group_id``: ids linked directly or indirectly by ``a, b``, with the smallest id of each group.

    Each round every id takes the smallest label among itself and its neighbours, then its
    label's label; labels are written after each round.  Labels only fall, so it ends, after
    about the logarithm of the longest chain.  An id with very many neighbours is aggregated
    partly before the shuffle, and its label goes to them by broadcast.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("w")).where("a <> b")
    both = durable(both.unionByName(both.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct(), "both")
    heavy = heavy_keys(both, ["w"])
    labels = durable(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("w"), F.first("u")).alias("label")), "labels")
    while True:
        near = split_join(both, labels.select(F.col("id").alias("w"), "label"), ["w"], heavy=heavy).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = durable(labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old")), "step")
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = durable(split_join(step, jump, ["label"], "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        drop_durable(labels, step)
        if new.where("label <> old").isEmpty():
            return new.select("id", F.col("label").alias("group_id"))
        labels = new.select("id", "label")


def canonical_map(groups: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``old_id, new_id`` for groups of ids: all but the canonical one (most mentions, longest name, smallest id) of each."""
    rows = mention_counts(entities.select("id", "name").dropDuplicates(["id"]), mentions).join(groups, "id")
    best = rows.groupBy("group_id").agg(F.max(F.struct("n_mentions", F.length("name").alias("l"), (-F.col("id")).alias("i"), F.col("id").alias("id"))).alias("m"))
    return rows.join(best, "group_id").select(F.col("id").alias("old_id"), F.col("m.id").alias("new_id")).where("old_id <> new_id")


def repoint(df: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the id it was merged into.  ``merges`` has one row per ``old_id``; nulls stay."""
    to = merges.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return split_join(df, to, [column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def fuse_aliases(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """``id, name, aliases`` of the entities that stay and took others in: earlier aliases and dropped names, sorted, distinct.

    ``entities`` has ``id, name, aliases`` (array, may be null).
    """
    gone = merges.join(entities.select(F.col("id").alias("old_id"), "name", "aliases"), "old_id").groupBy(F.col("new_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("more"))
    return entities.join(gone, "id").select("id", "name", F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "more")).alias("aliases"))


def keep_top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key in the given order, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def ranked(df: DataFrame, keys: list[str], order: list, parts: int | None = None) -> DataFrame:
    """``df`` with ``rank`` of every row within its key, however many rows a key has.

    Rows are dealt to ranges of key and order and written with the number of their range;
    a rank is the rows of the key in earlier ranges, of which there are few, and the place in its own.
    """
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = durable(df.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counted = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n"))
    before = counted.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), "_before")
    met = placed.join(before, [*(F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_range") == F.col("_of")]).select(*placed.columns, "_before")
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return met.withColumn("rank", (own + F.col("_before")).cast("long")).drop("_range", "_before")
