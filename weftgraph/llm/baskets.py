"""Pairs of items that occur together in baskets more often than chance would have it.

1. Rows become distinct (scope, basket, item); the shuffle is by all three, so neither a hot
   item nor a hot basket gathers in one task.
2. Items that cannot be in any result are dropped: ``n(a,b) <= min(n(a), n(b))``, so an
   item with fewer than ``min_count`` baskets fails the first condition, and one with
   ``n * min_lift > N`` fails the second.  Both follow from the conditions; no pair is lost.
3. Baskets become sorted arrays, equal arrays of a scope collapse into one with a weight.
4. Each distinct array yields its pairs once; weights are summed per pair, partly before
   the shuffle.
5. Baskets with more than ``block`` items (what is left of them) are not paired up.  With
   ``h`` of them in a scope they add at most ``h`` to a pair, so a pair of other baskets with
   ``n + h >= min_count`` is a candidate, and the large baskets that hold both its items
   are counted by joins.  A pair that only large baskets hold needs ``min_count`` of them:
   only items in as many are paired there, block by block, so that no task gets a basket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.pairs import array_pairs, group_pairs
from weftgraph.plans.durable import durable, kept, sized
from weftgraph.plans.skew import HEAVY_PARTS, split_join

BLOCK = 512


@kept("pairs")
def frequent_pairs(rows: DataFrame, min_count: int = 5, min_lift: int = 8, block: int = BLOCK) -> DataFrame:
    """``scope, a, b, n_ab, n_a, n_b, n, lift, conviction`` of pairs with ``n_ab >= min_count`` and ``n_ab * n >= min_lift * n_a * n_b``.

    ``rows`` has ``scope`` (string), ``basket`` and ``item`` (long).  Rows with a null in
    any of them take no part, repeats count once; a basket of one item gives no pair but
    counts in ``n``, the baskets of its scope.  ``lift`` is ``n_ab * n / (n_a * n_b)``;
    ``conviction`` of a → b is ``(1 - n_b/n) / (1 - n_ab/n_a)``, null where a never
    occurs without b.
    """
    base = durable(rows.select("scope", "basket", "item").dropna().distinct(), "baskets")
    total = base.count()
    size = durable(base.groupBy("scope", "basket").agg(F.count(F.lit(1)).alias("k")), "sizes")
    n = size.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    support = durable(base.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n_item")).join(n, "scope"), "support")
    good = support.where((F.col("n_item") >= min_count) & (F.col("n_item") * min_lift <= F.col("n")))
    heavy = support.where(F.col("n_item") * HEAVY_PARTS > F.lit(total)).select("scope", "item")
    held = split_join(base, good.select("scope", "item"), ["scope", "item"], "left_semi", heavy=heavy)

    big = size.where(F.col("k") > block)
    n_big = big.count()
    small = held if n_big == 0 else held.join(sized(big, n_big), ["scope", "basket"], "left_anti")
    arrays = small.groupBy("scope", "basket").agg(F.sort_array(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    weighted = arrays.groupBy("scope", "items").agg(F.count(F.lit(1)).alias("weight"))
    counted = weighted.select("scope", "weight", F.inline(array_pairs("items"))).groupBy("scope", "a", "b").agg(F.sum("weight").alias("n_ab"))
    if n_big:
        counted = _with_large(counted, durable(held.join(sized(big, n_big), ["scope", "basket"]), "large"), min_count, block)
    counted = counted.where(F.col("n_ab") >= min_count)
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  # products of counts may exceed a long
    one = good.select("scope", F.col("item").alias("a"), F.col("n_item").alias("n_a"), "n")
    two = good.select("scope", F.col("item").alias("b"), F.col("n_item").alias("n_b"))
    scored = counted.join(one, ["scope", "a"]).join(two, ["scope", "b"]).where(exact("n_ab") * exact("n") >= exact("n_a") * F.col("n_b") * min_lift)
    x = {c: F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")}
    return scored.select(
        "scope", "a", "b", "n_ab", "n_a", "n_b", "n",
        (x["n_ab"] * x["n"] / (x["n_a"] * x["n_b"])).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - x["n_b"] / x["n"]) / (1 - x["n_ab"] / x["n_a"])).alias("conviction"),
    )


def _with_large(counted: DataFrame, large: DataFrame, min_count: int, block: int) -> DataFrame:
    """Counts of pairs in small baskets, ``scope, a, b, n_ab``, with those of large ones (``scope, basket, item, k``) added.

    Pairs that cannot reach ``min_count`` may be missing.
    """
    have = large.select("scope", "basket").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("h"))
    candidates = durable(counted.join(sized(have), "scope", "left").where(F.col("n_ab") + F.coalesce("h", F.lit(0)) >= min_count), "candidates")
    first, second = large.select("scope", "basket", F.col("item").alias("a")), large.select("scope", "basket", F.col("item").alias("b"))
    more = candidates.where("h is not null").select("scope", "a", "b").join(first, ["scope", "a"]).join(second, ["scope", "basket", "b"], "left_semi").groupBy("scope", "a", "b").agg(F.count(F.lit(1)).alias("more"))
    known = candidates.join(more, ["scope", "a", "b"], "left").select("scope", "a", "b", (F.col("n_ab") + F.coalesce("more", F.lit(0))).alias("n_ab"))
    often = durable(large.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("scope", "item"), "often")
    if often.isEmpty():
        return known
    rest = durable(large.join(often, ["scope", "item"], "left_semi").select("scope", "basket", "item"), "rest")
    only = group_pairs(rest, ["scope", "basket"], "item", block).groupBy("scope", "a", "b").agg(F.count(F.lit(1)).alias("n_ab")).join(candidates, ["scope", "a", "b"], "left_anti")
    return known.unionByName(only)
