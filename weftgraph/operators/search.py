"""Search: keywords, BM25, and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators.read import located, original_place, scoped
from weftgraph.operators.resolve import keep_top, ranked
from weftgraph.plans.durable import BROADCAST_ROWS, durable, sized

#: Vectors of queries that are sent along with a scan: some 40 MB at 1,000 numbers each.
QUERIES = 10_000


def keyword_search(chunks: DataFrame, artifacts: DataFrame, query: str, k: int = 8, workspace: str | None = None) -> DataFrame:
    """``workspace, id, kind, name, start_line, end_line, path, artifact_kind, preview``: the first ``k`` chunks (by id) of a workspace with ``query`` in text or name.

    Only A to Z ignore case; ``%`` and ``_`` are wildcards.
    """
    rows = scoped(chunks, workspace).where(T.like_ascii(F.col("text"), query) | T.like_ascii(F.col("name"), query))
    found = located(rows, artifacts).select("workspace", "id", "kind", "name", "start_line", "end_line", "path", "artifact_kind", F.substring("text", 1, 600).alias("preview"))
    return keep_top(found, ["workspace"], [F.col("id")], k).drop("rank")


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, id, score`` by BM25 of every document (``id, text``) with a word of a query (``query_id, text``).

    Only postings of query terms leave the scan: the queries' distinct terms are joined
    first, by broadcast if they are counted to be few, then counted.
    """
    asked = durable(queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term")), "asked")
    terms = durable(asked.select("term").distinct(), "terms")
    few = terms.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    split = docs.select("id", T.words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("n_words", F.size("w"))
    stats = split.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("n_words").alias("avg_words"))
    postings = split.select("id", "n_words", F.explode("w").alias("term")).join(small(terms), "term").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n_words").alias("n_words"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    weighted = postings.join(small(df), "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_words") / F.col("avg_words")))
    return weighted.withColumn("part", part).join(sized(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def _order() -> list:
    return [F.col("score").desc(), F.col("id").asc()]


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best documents of each query by BM25; ties by id."""
    return keep_top(bm25_scores(docs, queries, k1, b), ["query_id"], _order(), k)


def fuse_rankings(rankings: list[DataFrame], k: int = 10, smooth: int = 60) -> DataFrame:
    """``query_id, id, score, rank`` by reciprocal rank fusion of tables ``query_id, id, rank``: the sum of ``1 / (smooth + rank)``."""
    rows = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "id", "rank"))
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (smooth + F.col("rank"))), 9).alias("score"))
    return keep_top(fused, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, score``: the cosine of each vector (``id, vector``) and each query (``query_id, vector``) of its length.

    Queries are a stated set; they are broadcast if counted to be few, and each vector meets them in the scan.
    """
    asked = durable(queries.select("query_id", F.col("vector").alias("q")).where("q is not null"), "asked")
    met = vectors.select("id", "vector").where("vector is not null").crossJoin(sized(asked, most=QUERIES))
    return met.where(F.size("vector") == F.size("q")).select("query_id", "id", F.round(T.cosine(F.col("vector"), F.col("q")), 9).alias("score"))


def vector_ranking(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` vectors nearest to each query by cosine, exactly; ties by id.

    A ranked limit within tasks leaves ``k`` rows per query and task for the shuffle.
    """
    return keep_top(vector_scores(vectors, queries), ["query_id"], _order(), k)


def per_root(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each root, then of all: ``hits`` has ``query_id, root, id, score``."""
    own = Window.partitionBy("query_id", "root").orderBy(F.col("score").desc(), F.col("id").asc())
    return keep_top(hits.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k).drop("_n"), ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)


def hybrid_search(chunks: DataFrame, artifacts: DataFrame, derived: DataFrame, query: str, k: int = 8, workspace: str | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """The ``k`` best chunks for a text: ``workspace, id, kind, name, start_line, end_line, path, page, artifact_kind, preview, score, retriever``.

    Rankings by BM25 and, where chunk vectors (``id, vector``) and the query's vector are
    given, by cosine are fused, each in full: a low rank still adds to a score.  Without any hit the keyword search answers, with score
    null.  What was derived from a paged file is cited by that file and page,
    a page's own chunk by its number.
    """
    rows = scoped(chunks, workspace)
    asked = chunks.sparkSession.createDataFrame([(0, query, query_vector)], "query_id long, text string, vector array<double>")
    once = rows.groupBy("id").agg(F.min(F.concat_ws(" ", "name", "text")).alias("text"))
    legs = [ranked(bm25_scores(once, asked), ["query_id"], _order())]
    if vectors is not None and query_vector is not None:
        legs.append(ranked(vector_scores(vectors.join(rows.select("id").distinct(), "id", "left_semi"), asked), ["query_id"], _order()))
    best = durable(fuse_rankings(legs, k).select("id", "score"), "best")
    columns = ["workspace", "id", "kind", "name", "start_line", "end_line", "path", "artifact_kind", "preview"]
    hits = located(rows.join(F.broadcast(best.select("id")), "id", "left_semi"), artifacts).join(F.broadcast(best), "id")
    found = hits.select("workspace", "id", "kind", "name", "start_line", "end_line", "path", "artifact_kind", F.substring("text", 1, 600).alias("preview"), "score", F.lit("hybrid").alias("retriever"))
    if best.isEmpty():
        found = keyword_search(chunks, artifacts, query, k, workspace).select(*columns, F.lit(None).cast("double").alias("score"), F.lit("keyword").alias("retriever"))
    paged = F.when(F.col("kind") == "page", T.page_of(F.col("name")))
    return original_place(found, derived).withColumn("page", F.coalesce("page", paged)).orderBy(F.col("score").desc_nulls_last(), "id")
