"""A selection of documents whose sources contribute target shares of all tokens.

1. Tokens are counted once per document and written.
2. Weights: with ``p`` the sources' own token shares and ``q`` the target shares of the
   sources that exist, ``w(x)`` is proportional to ``q * (p / q) ** x``.  At x = 0 these
   are the targets, at x = 1 the natural shares, which need no repetition.  x is bisected
   to the smallest value at which no source repeats more than it may for the given budget;
   without a budget, the budget is the largest that the targets allow (x = 0).  With a
   target entropy, ``w(x)`` is proportional to ``p ** x`` and x is bisected to that entropy.
3. Each source's part of the budget is realised by whole passes over its documents and
   one partial pass over a permutation: documents are ordered by a hash drawn from the
   seed, blocks are ranges of the hash.  Blocks are taken whole until the next would exceed
   the part; that one is cut into blocks again, until it is small enough to be put in
   order.  What comes out is one place in the permutation per source, so the selection is a
   filter and no document is shuffled.

Nothing but 4,096 rows per source reaches a single task, and one row per source the driver.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable, kept

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pattern that splits a text into the pieces the vocabulary was made for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of the hash that tell the blocks of one level apart.
BLOCK_BITS = 12
#: Documents of a block up to which it is put in order.
BLOCK_DOCS = 4096
#: Sources that targets may name; their rows go to the driver.
MAX_SOURCES = 100_000


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, ``_`` between words.  Null and blank become ``unknown``."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"(?U)\s+", " "))), r"[-_ ]+", "_")
    return F.coalesce(F.when(name != "", name), F.lit("unknown"))


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "source", "tokens"])

    return work


def token_sizes(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` with the exact number of tokens; null and empty texts have none.  Durable."""
    rows = documents.select(F.col("doc_id").cast("long"), source_name(F.col("source")).alias("source"), "text")
    return durable(rows.mapInArrow(_counter(f"{tokenizers}/{vocabulary}"), "doc_id long, source string, tokens long"), "tokens")


def _normalised(w: dict[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {s: x / total for s, x in w.items()} if total > 0 else w


def entropy(w: dict[str, float]) -> float:
    """Shannon entropy in nats."""
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def temperature_weights(sizes: dict[str, int], target_entropy: float) -> tuple[dict[str, float], float]:
    """Weights proportional to ``share ** x`` with the given entropy, and x.

    x lies in [0, 1]: an entropy below that of the natural shares gives x = 1, one above
    ``log(number of sources)`` gives x = 0 (equal weights).
    """
    p = _normalised({s: float(n) for s, n in sizes.items() if n > 0})
    lo, hi = 0.0, 1.0
    for _ in range(60):
        x = (lo + hi) / 2
        if entropy(_normalised({s: v**x for s, v in p.items()})) >= target_entropy:
            lo = x
        else:
            hi = x
    return _normalised({s: v**lo for s, v in p.items()}), lo


def capped_weights(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, float], budget: float | None = None) -> tuple[dict[str, float], float, float]:
    """Weights nearest to the targets that the repetition limits allow for a budget of tokens; x; the budget.

    Sources without tokens or without a positive target have no weight; the others'
    targets are scaled to 1.  A budget beyond ``sum(repeats * size)`` is cut down to it.
    """
    q = _normalised({s: t for s, t in targets.items() if t > 0 and sizes.get(s, 0) > 0 and repeats.get(s, 0) > 0})
    if not q:
        return {}, 0.0, 0.0
    room = {s: repeats[s] * sizes[s] for s in q}
    if budget is None:
        return q, 0.0, min(room[s] / w for s, w in q.items())
    budget = min(budget, sum(room.values()))
    # the far end of the scale is what the limits allow at most; it fits any budget up to their sum
    p = _normalised({s: float(room[s]) for s in q})
    fits = lambda w: all(budget * w[s] <= room[s] * (1 + 1e-12) for s in q)
    at = lambda x: _normalised({s: q[s] * (p[s] / q[s]) ** x for s in q})
    if fits(q):
        return q, 0.0, budget
    lo, hi = 0.0, 1.0
    for _ in range(60):
        x = (lo + hi) / 2
        lo, hi = (lo, x) if fits(at(x)) else (x, hi)
    return at(hi), hi, budget


def plan(sized_documents: DataFrame, targets: DataFrame, budget: float | None = None, target_entropy: float | None = None) -> tuple[list[tuple[str, float, float, int, int, float]], float]:
    """``source, target_share, weight, tokens, max_repeats, goal`` for each target source and each source of the documents; x.

    ``targets`` has ``source, target_share, max_repeats``; spellings are unified, of
    repeated sources the row with the largest share counts.  Sources without a target
    have weight and goal 0.  With ``target_entropy`` the sources' own shares are tempered to it and the
    targets only say which sources take part and how often they may repeat.
    """
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).limit(MAX_SOURCES + 1).collect()
    have = sized_documents.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if max(len(rows), len(have)) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    sizes = {r.source: int(r.tokens or 0) for r in have}
    share = {r.source: float(r.t.target_share or 0) for r in rows}
    repeats = {r.source: int(r.t.max_repeats or 0) for r in rows}
    weights, x, total = capped_weights(sizes, share, repeats, budget)
    if target_entropy is not None and weights:
        weights, x = temperature_weights({s: sizes[s] for s in weights}, target_entropy)
        most = min(repeats[s] * sizes[s] / w for s, w in weights.items())
        total = most if budget is None else min(budget, most)
    return [(s, share.get(s, 0.0), weights.get(s, 0.0), sizes.get(s, 0), repeats.get(s, 0), weights.get(s, 0.0) * total) for s in sorted(share.keys() | sizes.keys())], x


def _ends(docs: DataFrame, rests: dict[str, float]) -> list[tuple[str, int, int]]:
    """Where the partial pass over each source ends: ``source, rank, doc_id`` of its last document, none where it takes nothing.

    ``docs`` has ``source, doc_id, tokens, rank`` with ranks of 60 bits; ``rests`` says how many tokens a source may bring.
    """
    spark = docs.sparkSession
    open_ = {s: (0, 0) for s in rests}  # the block that has to be cut, as the upper bits of its ranks, and the tokens before it
    done: dict[str, tuple[int, int]] = {}
    small: dict[str, tuple[int, int, int]] = {}
    level = 0
    while open_:
        shift = 60 - BLOCK_BITS * (level + 1)
        where = F.broadcast(spark.createDataFrame([(s, p, t, float(rests[s])) for s, (p, t) in open_.items()], "source string, above long, taken long, rest double"))
        inside = docs.join(where, "source").where(F.shiftright("rank", shift + BLOCK_BITS) == F.col("above")) if level else docs.join(where, "source")
        blocks = inside.groupBy("source", F.shiftright("rank", shift).alias("block"), "taken", "rest").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        before = F.col("taken") + F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")
        first = blocks.withColumn("before", before).where(F.col("before") + F.col("n") > F.col("rest")).groupBy("source").agg(F.min(F.struct("block", "before", "docs")).alias("b")).collect()
        cut = {r.source: (r.b.block, r.b.before) for r in first}
        done |= dict.fromkeys(open_.keys() - cut.keys(), (1 << 60, 0))  # the whole block fits, so everything does
        small |= {r.source: (r.b.block, r.b.before, shift) for r in first if r.b.docs <= BLOCK_DOCS or shift == 0}
        open_ = {s: c for s, c in cut.items() if s not in small}
        level += 1
    out = [(s, *end) for s, end in done.items()]
    if small:
        where = F.broadcast(spark.createDataFrame([(s, b, t, k, float(rests[s])) for s, (b, t, k) in small.items()], "source string, block long, taken long, shift int, rest double"))
        run = F.col("taken") + F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        inside = docs.join(where, "source").where(F.expr("shiftright(rank, shift)") == F.col("block")).withColumn("run", run)
        last = inside.groupBy("source", "block", "shift").agg(F.max(F.when(F.col("run") <= F.col("rest"), F.struct("rank", "doc_id"))).alias("e")).collect()
        out += [(r.source, r.e.rank, r.e.doc_id) if r.e else (r.source, (r.block << r.shift) - 1, 1 << 62) for r in last]
    return out


_PLAN = "source string, target_share double, weight double, source_tokens long, max_repeats int, goal double"


@kept("selection")
def mix(sized_documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 1, target_entropy: float | None = None) -> DataFrame:
    """``doc_id, source, tokens, copies``: the documents selected and how often each is used, at most ``max_repeats``.

    Documents without tokens and of sources without a target are left out.  A source gets
    at most its goal, and misses it by less than its document next to the cut.
    The same seed gives the same selection, whatever the partitioning.
    """
    spark = sized_documents.sparkSession
    parts, rests = [], {}
    for source, _, _, size, most, goal in plan(sized_documents, targets, budget, target_entropy)[0]:
        if goal > 0:
            passes = min(most, int(goal / size + 1e-9))
            parts.append((source, passes))
            if passes < most:
                rests[source] = goal - passes * size
    whole = F.broadcast(spark.createDataFrame(parts, "source string, passes int"))
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 4)
    docs = sized_documents.where("tokens > 0").join(whole, "source").withColumn("rank", rank)
    ends = F.broadcast(spark.createDataFrame(_ends(docs.select("source", "doc_id", "tokens", "rank"), rests), "source string, last long, last_doc long"))
    more = F.coalesce((F.col("rank") < F.col("last")) | ((F.col("rank") == F.col("last")) & (F.col("doc_id") <= F.col("last_doc"))), F.lit(False))
    return docs.join(ends, "source", "left").select("doc_id", "source", "tokens", (F.col("passes") + more.cast("int")).alias("copies")).where("copies > 0")


def shares(selection: DataFrame, sized_documents: DataFrame, targets: DataFrame, budget: float | None = None, target_entropy: float | None = None) -> DataFrame:
    """Per source: target, planned and reached share, tokens reached, documents, largest number of copies, and the exponent x of the weights."""
    spark = selection.sparkSession
    rows, x = plan(sized_documents, targets, budget, target_entropy)
    planned = spark.createDataFrame(rows, _PLAN)
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    reached = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_copies")]
    return planned.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", F.col("weight").alias("planned_share"), reached.alias("reached_share"), *filled, "max_repeats", F.lit(x).alias("exponent"))
