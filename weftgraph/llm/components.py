"""Groups of records that are linked directly or indirectly.

1. Each task runs union-find over its edges and keeps a spanning forest: every vertex
   linked to the smallest one it reaches there.  Most edges end here.
2. Forests are merged in fewer and fewer tasks, none of which gets more than ``bound``
   links, as long as merging shrinks them.
3. What still exceeds ``bound`` (many groups rather than large ones) is contracted: every
   vertex joins its neighbour that is first in a random order drawn anew each round, and
   links become links between those; the expected number of vertices falls by a constant
   factor each round.  The last links, at most ``bound``, go through one union-find, and
   the joins of the rounds are composed backwards.

Every round is a written table; losing an executor repeats at most one round's tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import drop_durable, durable
from weftgraph.plans.skew import split_join

#: Links one task may hold: some 200 MB of arrays while they are merged.
BOUND = 2_000_000

_LINK = "id long, root long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of edges: each vertex that is not its group's smallest, and that smallest.

    Union-find by hooking larger roots onto smaller ones, all edges at once, with full path compression
    after each pass.
    """
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(names))
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = parent != np.arange(len(names))
    return names[child], names[parent[child]]


def _union(bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > bound:
                held = [merged()]
                rows = len(held[0][0])
                if rows > bound // 2:  # too many links to go on with: hand them on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["id", "root"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["id", "root"])

    return work


def _contract(links: DataFrame, bound: int, seed: int) -> DataFrame:
    """``id, root`` for links too many for one task; ``root`` is some vertex of the group, the same for all of it."""
    maps = []
    count = links.count()
    while count > bound:
        both = links.select(F.col("id").alias("v"), F.col("root").alias("w")).unionByName(links.select(F.col("root").alias("v"), F.col("id").alias("w")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed + len(maps))).alias("h"), F.col(c).alias("x"))
        first = durable(both.groupBy("v").agg(F.min(order("w")).alias("m")).select("v", F.least(F.col("m"), order("v"))["x"].alias("to")), "hook")
        maps.append(first)
        left = split_join(links.select(F.col("id").alias("v"), "root"), first, ["v"]).select(F.col("to").alias("id"), F.col("root").alias("v"))
        moved = split_join(left, first, ["v"]).select("id", F.col("to").alias("root")).where("id <> root")
        old, links = links, durable(moved.select(F.greatest("id", "root").alias("id"), F.least("id", "root").alias("root")).distinct(), "contracted")
        drop_durable(old)
        count = links.count()
    final = links.repartition(1).mapInArrow(_union(1 << 62), _LINK)
    for first in reversed(maps):
        up = final.select(F.col("id").alias("to"), F.col("root"))
        final = durable(split_join(first, up, ["to"], "left").select(F.col("v").alias("id"), F.coalesce("root", "to").alias("root")), "labels")
        drop_durable(first)
    return final


def components(edges: DataFrame, bound: int = BOUND, seed: int = 17) -> DataFrame:
    """``entity_id, group_id``: every id at an end of an edge, and the smallest id it is linked to.

    ``edges`` has ``a`` and ``b`` (long), in any direction, repeated or not.  Edges with a
    null end and loops link nothing and bring no id in.  Without edges the result is empty.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = durable(clean.mapInArrow(_union(bound), _LINK), "forest")
    count, before = links.count(), float("inf")
    while count > bound and count < 0.9 * before:
        before = count
        old, links = links, durable(links.repartition(-(-count // bound)).mapInArrow(_union(bound), _LINK), "forest")
        drop_durable(old)
        count = links.count()
    if count <= bound:
        labels = durable(links.repartition(1).mapInArrow(_union(1 << 62), _LINK), "labels")
    else:
        some = _contract(links, bound, seed)
        smallest = some.groupBy("root").agg(F.min(F.least("id", "root")).alias("group_id"))
        labels = durable(split_join(some, smallest, ["root"]).where("id <> group_id").select("id", F.col("group_id").alias("root")), "labels")
    drop_durable(links)
    roots = labels.select("root").distinct()
    return labels.select(F.col("id").alias("entity_id"), F.col("root").alias("group_id")).unionByName(roots.select(F.col("root").alias("entity_id"), F.col("root").alias("group_id")))
