"""Linking entities and artifacts: edges of the graph.

All operators are pure: tables in, edges out.  Rebuilding an edge type means replacing it
with the operator's result, so repeats of the input change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import patterns as P
from weftgraph.functions import text as T
from weftgraph.operators.extract import current_artifacts, kind_of
from weftgraph.operators.pairs import BLOCK, group_pairs


def cooccurrence(mentions: DataFrame, chunks: DataFrame, min_shared: int = 2, block: int = BLOCK) -> DataFrame:
    """``workspace, src_id, dst_id, shared, first_page, confidence`` of entities that share chunks; src < dst.

    Mentions of chunks that do not exist and null ids count for nothing, an entity counts
    once per chunk.  first_page is the page of the first shared chunk (by id), which may
    have none; confidence is ``min(1, 0.4 + 0.1 * shared)``.

    Each chunk's pairs are made in its own row, or in blocks where it has many mentions, and are
    counted partly before the shuffle.
    """
    pages = chunks.where("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(T.page_of(F.col("name"))).alias("page"))
    said = mentions.select("workspace", "chunk_id", "entity_id").dropna()
    pairs = group_pairs(said, ["workspace", "chunk_id"], "entity_id", block, pages.select("chunk_id"))
    counted = pairs.groupBy("workspace", F.col("a").alias("src_id"), F.col("b").alias("dst_id")).agg(F.count(F.lit(1)).alias("shared"), F.min("chunk_id").alias("chunk_id")).where(F.col("shared") >= min_shared)
    placed = counted.join(pages.where("page is not null"), "chunk_id", "left")
    return placed.select("workspace", "src_id", "dst_id", "shared", F.col("page").alias("first_page"), F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.1) * F.col("shared")).alias("confidence"))


def grounded(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``workspace, entity_id, name, etype, chunk_id, kind``: entities with the chunks of certain artifact kinds that mention them."""
    arts = current_artifacts(artifacts.select("id", "workspace", "path", "kind", "sha", "ingested_at")).select(F.col("id").alias("artifact_id"), kind_of(F.col("kind")).alias("kind")).where(F.col("kind").isin(*kinds))
    places = chunks.select(F.col("id").alias("chunk_id"), "artifact_id").dropDuplicates(["chunk_id"]).join(arts, "artifact_id").select("chunk_id", "kind")
    who = entities.select(F.col("id").alias("entity_id"), "workspace", "name", "etype").distinct()
    said = mentions.select("entity_id", "chunk_id").distinct()
    return said.join(places, "chunk_id").join(who, "entity_id").select("workspace", "entity_id", "name", "etype", "chunk_id", "kind")


def doc_code_links(docs: DataFrame, code: DataFrame) -> DataFrame:
    """``workspace, src_id, dst_id, confidence, method, name, code_symbol, doc_chunk, code_chunk``: what documents call, what code defines.

    ``docs`` and ``code`` are rows of :func:`grounded`.  A name links to the symbol of the
    same name (exact, 0.7), else to one equal without case, ``_``, ``-`` and blanks if four
    characters remain (fuzzy, 0.5).  Of several symbols the first (smallest entity, then chunk) counts.
    """
    first = F.min(F.struct("entity_id", "chunk_id", "name"))
    exact = code.where("name is not null").groupBy("workspace", "name").agg(first.alias("x"))
    fuzzy = code.where("name is not null").groupBy("workspace", T.symbol_key(F.col("name")).alias("key")).agg(first.alias("f"))
    names = docs.where("name is not null").groupBy("workspace", "entity_id", "name").agg(F.min("chunk_id").alias("doc_chunk")).withColumn("key", F.when(F.length(T.symbol_key(F.col("name"))) >= 4, T.symbol_key(F.col("name"))))
    hit = names.join(exact, ["workspace", "name"], "left").join(fuzzy, ["workspace", "key"], "left").withColumn("m", F.coalesce("x", "f")).where("m is not null")
    is_exact = F.col("x").isNotNull()
    return hit.select(
        "workspace", F.col("entity_id").alias("src_id"), F.col("m.entity_id").alias("dst_id"),
        F.when(is_exact, F.lit(0.7)).otherwise(F.lit(0.5)).alias("confidence"), F.when(is_exact, "exact").otherwise("fuzzy").alias("method"),
        "name", F.col("m.name").alias("code_symbol"), "doc_chunk", F.col("m.chunk_id").alias("code_chunk"),
    )


def root_of(places: DataFrame, roots: DataFrame, path: str = "path", root: str = "root_path") -> DataFrame:
    """``places`` with ``root``: the longest root that is the path or a directory above it; null if none is.

    ``roots`` has the workspace's roots.  The paths' own directories are looked up among
    them by equality, so any number of roots will do.  A root ``/a/svc`` does not hold ``/a/svc2``.
    """
    known = roots.select("workspace", F.regexp_replace(root, r"(?<=.)/+\z", "").alias("_dir")).distinct()
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = places.select("workspace", path).where(F.col(path).isNotNull()).distinct()
    best = paths.select("workspace", path, F.explode(above).alias("_dir")).join(known, ["workspace", "_dir"]).groupBy("workspace", path).agg(F.max_by("_dir", F.length("_dir")).alias("root"))
    return places.join(best, ["workspace", path], "left")


def bind(endpoints: DataFrame, most: int = P.PAIRS_PER_KEY) -> DataFrame:
    """``workspace, kind, key, client_artifact, client_line, server_artifact, server_line, cross_repo, confidence``, distinct.

    ``endpoints`` has ``workspace, kind, role, key, artifact_id, line, root``.  Every client
    is bound to every server of its key, unless the key has more than ``most`` such pairs:
    then it is too general and binds nothing.  The counts of both sides decide that before
    the join, so no hot key is ever paired.  An endpoint is not bound to its own place.
    cross_repo is 1 if both roots are known and differ; confidence is 0.55 for keys with parameters, else 0.7.
    """
    on = ["workspace", "kind", "key"]
    rows = endpoints.select(*on, "role", "artifact_id", "line", "root").where("key is not null")
    sides = rows.groupBy(*on).agg(F.count_if(F.col("role") == "client").alias("c"), F.count_if(F.col("role") == "server").alias("s")).where((F.col("c") > 0) & (F.col("s") > 0) & (F.col("c") * F.col("s") <= most)).select(*on)
    good = rows.join(sides, on, "left_semi")
    client = good.where("role = 'client'").select(*on, F.col("artifact_id").alias("client_artifact"), F.col("line").alias("client_line"), F.col("root").alias("client_root"))
    server = good.where("role = 'server'").select(*on, F.col("artifact_id").alias("server_artifact"), F.col("line").alias("server_line"), F.col("root").alias("server_root"))
    apart = ~(F.col("client_artifact").eqNullSafe(F.col("server_artifact")) & F.col("client_line").eqNullSafe(F.col("server_line")))
    cross = F.coalesce((F.col("client_root") != F.col("server_root")).cast("int"), F.lit(0))
    made = client.join(server, on).where(apart)
    return made.select(*on, "client_artifact", "client_line", "server_artifact", "server_line", cross.alias("cross_repo"), F.when(F.contains("key", F.lit("{}")), F.lit(0.55)).otherwise(F.lit(0.7)).alias("confidence")).distinct()


def unbound(endpoints: DataFrame) -> DataFrame:
    """``workspace, role, kind, key, path, line``: endpoints without another side, the first place of each key.

    First is by artifact id, then line.  Needs ``path`` beside the columns of :func:`bind`.
    """
    on = ["workspace", "kind", "key"]
    rows = endpoints.where("key is not null")
    sides = rows.groupBy(*on).agg(F.count_if(F.col("role") == "client").alias("c"), F.count_if(F.col("role") == "server").alias("s")).where("c = 0 or s = 0")
    first = rows.groupBy(*on, "role").agg(F.min(F.struct("artifact_id", "line", "path")).alias("m"))
    return first.join(sides, on, "left_semi").select("workspace", "role", "kind", "key", F.col("m.path").alias("path"), F.col("m.line").alias("line"))


def call_edges(calls: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of calls, one for each call site, and the symbols that have to be added for them.

    ``calls`` has ``workspace, artifact_id, enclosing, callee``; ``symbols`` has
    ``workspace, id, name``.  Names are resolved in the whole workspace; calls from an
    unknown enclosing definition or to itself are left out; an unknown callee becomes a
    symbol.  Edges: ``id, workspace, src_id, dst_id, confidence, method``; ids follow from the ends and a count of the sites.
    """
    known = symbols.where("name is not null").groupBy("workspace", "name").agg(F.min("id").alias("id"))
    inside = calls.where("enclosing is not null and callee is not null and enclosing <> callee").join(known.select("workspace", F.col("name").alias("enclosing"), F.col("id").alias("src_id")), ["workspace", "enclosing"])
    new = inside.select("workspace", F.col("callee").alias("name")).distinct().join(known, ["workspace", "name"], "left_anti").withColumn("id", entity_id(F.col("workspace"), F.col("name"), F.lit("symbol"))).select("workspace", "id", "name")
    every = known.unionByName(new.select("workspace", "name", "id"))
    sites = inside.groupBy("workspace", "src_id", "callee").agg(F.count(F.lit(1)).alias("n"))
    edges = sites.join(every.select("workspace", F.col("name").alias("callee"), F.col("id").alias("dst_id")), ["workspace", "callee"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return edges.select(T.stable_id("workspace", "src_id", "dst_id", F.lit("calls"), "k").alias("id"), "workspace", "src_id", "dst_id", F.lit(1.0).alias("confidence"), F.lit("structural").alias("method")), new


def _call_mark(chunk_id: Column, surface: Column) -> Column:
    return F.shiftright(F.xxhash64(F.lit("call"), chunk_id, surface), 24)


def is_call_mention() -> Column:
    """Whether a row of mentions was made by :func:`call_mentions`; holds for merged entities too."""
    return F.coalesce(F.shiftright("id", 24) == _call_mark(F.col("chunk_id"), F.col("surface")), F.lit(False))


def call_mentions(calls: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, workspace, entity_id, chunk_id, surface``: the callees, one for each call site, in the first chunk of the enclosing definition.

    ``calls`` and ``symbols`` are those of :func:`call_edges`, with the added symbols.  First is by
    start line, of equal ones the longest.  The id's upper bits come from chunk and surface, the
    lower 24 count the sites.
    """
    known = symbols.where("name is not null").groupBy("workspace", "name").agg(F.min("id").alias("id"))
    inside = calls.where("enclosing is not null and callee is not null and enclosing <> callee").join(known.select("workspace", F.col("name").alias("enclosing")), ["workspace", "enclosing"], "left_semi")
    first = chunks.groupBy("workspace", "artifact_id", F.col("name").alias("enclosing")).agg(F.min(F.struct("start_line", -F.col("end_line"), "id")).alias("c"))
    sites = inside.groupBy("workspace", "artifact_id", "enclosing", F.col("callee").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    said = sites.join(first, ["workspace", "artifact_id", "enclosing"]).select("workspace", F.col("c.id").alias("chunk_id"), "surface", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    found = said.join(known.select("workspace", F.col("name").alias("surface"), F.col("id").alias("entity_id")), ["workspace", "surface"])
    return found.select((F.shiftleft(_call_mark(F.col("chunk_id"), F.col("surface")), 24) + F.col("k")).alias("id"), "workspace", "entity_id", "chunk_id", "surface")


def entity_id(workspace: Column, name: Column, etype: Column) -> Column:
    """Stable id of an entity from what makes it unique."""
    return T.stable_id(workspace, name, etype)


def narrowest(points: DataFrame, spans: DataFrame, bucket: int = 1024) -> DataFrame:
    """``points`` (``owner, at``) with ``name``: the shortest span (``owner, name, lo, hi``) that holds the point; null if none does.

    Spans are entered in every bucket they touch, so points meet only spans of their
    bucket.  Of equally short spans the one that begins first counts, then the smaller name.
    """
    entered = spans.where("lo <= hi").select("owner", "name", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("b"))
    places = points.select("owner", "at").where("at is not null").distinct().withColumn("b", F.floor(F.col("at") / bucket))
    best = places.join(entered, ["owner", "b"]).where("lo <= at and at <= hi").groupBy("owner", "at").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo", "name")).alias("m"))
    return points.join(best.select("owner", "at", F.col("m.name").alias("name")), ["owner", "at"], "left")

