"""Read side: what can be asked of a graph.

Functions take tables and parameters and return DataFrames.  A parameter ``workspace`` of
None means all workspaces; limits hold per workspace then.  Ties are always broken, so
results do not depend on the order of rows.  Rows delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators.extract import current_artifacts, kind_of
from weftgraph.operators.resolve import keep_top, ranked

#: Rows of a page and before it up to which a limit within tasks serves (Spark's own bound).
SHALLOW = 1000


def scoped(df: DataFrame, workspace: str | None) -> DataFrame:
    """Rows of one workspace, or all."""
    return df if workspace is None else df.where(F.col("workspace") == workspace)


def _by_kind(artifacts: DataFrame) -> DataFrame:
    """``workspace, artifacts, by_kind``: counts as an array of ``kind, n`` sorted by kind (a handful of kinds)."""
    counted = current_artifacts(artifacts).groupBy("workspace", kind_of(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("workspace").agg(F.sum("n").alias("artifacts"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("by_kind"))


def list_workspaces(workspaces: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``name, created_at, artifacts, by_kind`` (as ``kind=n`` texts) of every workspace, by creation and name."""
    counts = _by_kind(artifacts).select(F.col("workspace").alias("name"), "artifacts", F.transform("by_kind", lambda x: F.concat(F.coalesce(x["kind"], F.lit("")), F.lit("="), x["n"].cast("string"))).alias("by_kind"))
    rows = workspaces.select("name", "created_at").distinct().join(counts, "name", "left")
    return rows.select("name", "created_at", F.coalesce("artifacts", F.lit(0)).alias("artifacts"), F.coalesce(F.array_join("by_kind", ","), F.lit("")).alias("by_kind")).orderBy("created_at", "name")


def list_artifacts(artifacts: DataFrame, workspace: str | None = None) -> DataFrame:
    """``workspace, id, path, kind, lang, lens, provenance, ingested_at`` by workspace, kind and path."""
    rows = scoped(current_artifacts(artifacts), workspace)
    return rows.select("workspace", "id", "path", "kind", "lang", "lens", T.json_text(F.col("props"), "$.provenance").alias("provenance"), "ingested_at").orderBy("workspace", "kind", "path", "id")


def located(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Chunks (once each) with ``path`` and ``artifact_kind``."""
    arts = current_artifacts(artifacts).select(F.col("id").alias("artifact_id"), "path", kind_of(F.col("kind")).alias("artifact_kind"))
    return chunks.dropDuplicates(["id"]).join(arts, "artifact_id")


def chunks_page(chunks: DataFrame, artifacts: DataFrame, workspace: str | None = None, kind: str | None = None, limit: int = 200, offset: int = 0, after: int | None = None) -> DataFrame:
    """``workspace, id, kind, name, start_line, end_line, path, artifact_kind, preview``: a page of each workspace's chunks by id; previews of 400 characters.

    ``after`` is the last id of the page before; it costs no more for late pages, while an
    ``offset`` has to count.  Deep offsets are counted in ranges, not in one task.
    """
    rows = scoped(chunks, workspace)
    rows = located(rows if after is None else rows.where(F.col("id") > after), artifacts)
    if kind is not None:
        rows = rows.where(F.col("artifact_kind") == kind)
    page = rows.select("workspace", "id", "kind", "name", "start_line", "end_line", "path", "artifact_kind", F.substring("text", 1, 400).alias("preview"))
    if offset + limit <= SHALLOW:
        return keep_top(page, ["workspace"], [F.col("id")], offset + limit).where(F.col("rank") > offset).drop("rank")
    places = ranked(rows.select("workspace", "id"), ["workspace"], [F.col("id")]).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select("id")
    return page.join(places, "id", "left_semi").select(*page.columns)


def get_chunk(chunks: DataFrame, artifacts: DataFrame, workspace: str, chunk_id: int) -> DataFrame:
    """The chunk's row with ``path`` and ``artifact_kind``, or nothing."""
    return located(scoped(chunks, workspace).where(F.col("id") == chunk_id), artifacts)


def overview(workspaces: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """``workspace, intent, artifacts_by_kind, cross_source_edges, structural_bindings, cross_repo_bindings``."""
    counts = _by_kind(artifacts).select("workspace", F.array_join(F.transform("by_kind", lambda x: F.concat(F.coalesce(x["kind"], F.lit("")), F.lit("="), x["n"].cast("string"))), ",").alias("artifacts_by_kind"))
    binding = F.col("edge_type") == "binding"
    sums = (
        edges.select("id", "workspace", "edge_type", "cross_source", "props").distinct().groupBy("workspace")
        .agg(
            F.count_if(F.col("cross_source") == 1).alias("cross_source_edges"),
            F.count_if(binding).alias("structural_bindings"),
            F.coalesce(F.sum(F.when(binding, T.json_int(F.col("props"), "$.cross_repo"))), F.lit(0)).alias("cross_repo_bindings"),
        )
    )
    rows = workspaces.select(F.col("name").alias("workspace"), "intent").distinct().join(counts, "workspace", "left").join(sums, "workspace", "left")
    return rows.select("workspace", "intent", F.coalesce("artifacts_by_kind", F.lit("")).alias("artifacts_by_kind"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cross_source_edges", "structural_bindings", "cross_repo_bindings")])


def cross_edges(edges: DataFrame, entities: DataFrame, name: str | None = None, min_confidence: float = 0.0, workspace: str | None = None) -> DataFrame:
    """``workspace, id, edge_type, confidence, method, asserted, src, src_type, dst, dst_type``: cross-source edges, of one entity name or all.

    Edges without confidence are left out; claims that are not asserted are in, marked.
    """
    rows = scoped(edges, workspace).where((F.col("cross_source") == 1) & (F.col("confidence") >= min_confidence) & ~F.isnan("confidence"))
    rows = rows.select("id", "workspace", "edge_type", "confidence", "method", "asserted", "src_id", "dst_id").distinct()
    ent = entities.select("id", "name", "etype").distinct()
    out = rows.join(ent.toDF("src_id", "src", "src_type"), "src_id").join(ent.toDF("dst_id", "dst", "dst_type"), "dst_id")
    if name is not None:
        out = out.where((F.col("src") == name) | (F.col("dst") == name))
    return out.select("workspace", "id", "edge_type", "confidence", "method", "asserted", "src", "src_type", "dst", "dst_type")


def typed_bindings(edges: DataFrame) -> DataFrame:
    """Binding edges with their props as columns; ids of artifacts under either of their two names."""
    rows = edges.where("edge_type = 'binding'").select("id", "workspace", "confidence", "method", "props").distinct()
    number = lambda f: T.json_int(F.col("props"), f"$.{f}")
    return rows.select(
        "id", "workspace", "confidence", "method", T.json_text(F.col("props"), "$.kind").alias("kind"), T.json_text(F.col("props"), "$.key").alias("key"), number("cross_repo").alias("cross_repo"),
        F.coalesce(number("client_artifact"), number("client_artifact_id")).alias("client_artifact"), number("client_line").alias("client_line"),
        F.coalesce(number("server_artifact"), number("server_artifact_id")).alias("server_artifact"), number("server_line").alias("server_line"),
    )


def typed_connectors(edges: DataFrame) -> DataFrame:
    """Connector edges with their props as columns: ``workspace, kind, role, key, artifact_id, line``."""
    rows = edges.where("edge_type = 'connector'").select("id", "workspace", "props").distinct()
    text = lambda f: T.json_text(F.col("props"), f"$.{f}")
    return rows.select("id", "workspace", text("kind").alias("kind"), text("role").alias("role"), text("key_norm").alias("key"), T.json_int(F.col("props"), "$.artifact_id").alias("artifact_id"), T.json_int(F.col("props"), "$.line").alias("line"))


def connections(edges: DataFrame, artifacts: DataFrame, kind: str | None = None, min_confidence: float = 0.0, cross_repo_only: bool = False, workspace: str | None = None) -> DataFrame:
    """``workspace, id, kind, key, cross_repo, confidence, method, client_path, client_line, server_path, server_line``, best first."""
    rows = scoped(typed_bindings(edges), workspace).where((F.col("confidence") >= min_confidence) & ~F.isnan("confidence"))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if cross_repo_only:
        rows = rows.where("cross_repo = 1")
    arts = current_artifacts(artifacts.select("id", "workspace", "path", "sha", "ingested_at")).select("id", "path")
    out = rows.join(arts.toDF("client_artifact", "client_path"), "client_artifact").join(arts.toDF("server_artifact", "server_path"), "server_artifact")
    columns = ["workspace", "id", "kind", "key", "cross_repo", "confidence", "method", "client_path", "client_line", "server_path", "server_line"]
    return out.select(*columns).orderBy(F.col("cross_repo").desc(), F.col("confidence").desc(), "kind", "key", "client_path", "client_line", "id")


def count_of(props: Column) -> Column:
    """The number of mentions that props state, as double; null if they state none."""
    return T.json_number(props, "$.count")


def list_entities(entities: DataFrame, etype: str | None = None, limit: int = 100, workspace: str | None = None) -> DataFrame:
    """``workspace, id, name, type, count, first_page, rank``: entities by the count in their props, then name and id."""
    rows = scoped(entities, workspace).select("id", "workspace", "name", "etype", "props").distinct()
    if etype is not None:
        rows = rows.where(F.col("etype") == etype)
    typed = rows.select("workspace", "id", "name", F.col("etype").alias("type"), count_of(F.col("props")).alias("count"), T.json_int(F.col("props"), "$.first_page").alias("first_page"))
    return keep_top(typed, ["workspace"], [F.coalesce("count", F.lit(0.0)).desc(), F.col("name").asc(), F.col("id").asc()], limit)


def directed(edges: DataFrame) -> DataFrame:
    """Edges with both ends, seen from each end: ``workspace, edge_id, entity_id, other_id, forward, relation, weight, confidence, first_page``.

    forward is true seen from the source.  A loop is seen once.
    """
    number = lambda f: T.json_number(F.col("props"), f"$.{f}")
    rows = edges.where("src_id is not null and dst_id is not null").select("id", "workspace", "src_id", "dst_id", "edge_type", "confidence", "props").distinct()
    rows = rows.select(F.col("id").alias("edge_id"), "workspace", "src_id", "dst_id", F.col("edge_type").alias("relation"), number("shared").alias("weight"), F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"), T.json_int(F.col("props"), "$.first_page").alias("first_page"))
    there = F.struct(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("other_id"), F.lit(True).alias("forward"))
    back = F.struct(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("other_id"), F.lit(False).alias("forward"))
    ends = F.when(F.col("src_id") == F.col("dst_id"), F.array(there)).otherwise(F.array(there, back))
    return rows.select("workspace", "edge_id", "relation", "weight", "confidence", "first_page", F.inline(ends))


def _strength() -> Column:
    return F.coalesce(F.nullif("weight", F.lit(0.0)), F.nullif("confidence", F.lit(0.0)), F.lit(0.0))


def neighbors(edges: DataFrame, entities: DataFrame, name: str, workspace: str | None = None, relation: str | None = None, etype: str | None = None, limit: int = 50) -> DataFrame:
    """``workspace, entity, type, relation, weight, confidence, first_page``: what the entities of a name are linked to, strongest first.

    Strength is the weight, else the confidence, else 0 (0 counts as none).  An edge
    between two entities of the name is listed once, with its destination.  The name's
    ids, a handful, are broadcast, so edges are scanned once and not shuffled.
    """
    ent = entities.select("id", "name", "etype").distinct()
    ids = scoped(entities, workspace).where(F.col("name") == name).select(F.col("id").alias("entity_id")).distinct()
    rows = scoped(directed(edges), workspace)
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    both = ids.select(F.col("entity_id").alias("other_id"), F.lit(True).alias("_same"))
    mine = rows.join(ids, "entity_id", "left_semi").join(both, "other_id", "left").where(F.col("forward") | F.col("_same").isNull())
    out = mine.join(ent.toDF("other_id", "entity", "type"), "other_id")
    if etype is not None:
        out = out.where(F.col("type") == etype)
    return out.orderBy(_strength().desc(), "entity", "relation", "edge_id").limit(limit).select("workspace", "entity", "type", "relation", "weight", "confidence", "first_page")


def ranked_neighbors(edges: DataFrame, entities: DataFrame, limit: int = 50) -> DataFrame:
    """:func:`neighbors` for every entity at once: ``workspace, entity_id, other_id, entity, type, relation, weight, confidence, rank``."""
    ent = entities.select("id", "name", "etype").distinct().toDF("other_id", "entity", "type")
    seen = directed(edges).join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").join(ent, "other_id")
    order = [_strength().desc(), F.col("entity").asc_nulls_first(), F.col("relation").asc_nulls_first(), F.col("edge_id")]
    return keep_top(seen, ["entity_id"], order, limit).select("workspace", "entity_id", "other_id", "entity", "type", "relation", "weight", "confidence", "rank")


def is_provisional(props: Column) -> Column:
    """Whether props say ``provisional: true`` or 1."""
    return F.coalesce(T.json_text(props, "$.provisional").isin("true", "1"), F.lit(False))


def pending_entities(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = 120, workspace: str | None = None) -> DataFrame:
    """``workspace, id, name, current_type, count, sample, rank``: provisional entities by count, with 220 characters of the first chunk that mentions them.

    First is by mention id, then chunk id, among chunks that exist; sample is null without one.
    Only the listed entities' mentions are joined to texts.
    """
    rows = scoped(entities, workspace).select("id", "workspace", "name", "etype", "props").distinct().where(is_provisional(F.col("props")))
    top = keep_top(rows.select("workspace", "id", "name", F.col("etype").alias("current_type"), count_of(F.col("props")).alias("count")), ["workspace"], [F.coalesce("count", F.lit(0.0)).desc(), F.col("name").asc(), F.col("id").asc()], limit)
    there = chunks.select(F.col("id").alias("chunk_id")).distinct()
    listed = mentions.select("id", "entity_id", "chunk_id").join(top.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(there, "chunk_id", "left_semi")
    first = listed.groupBy("entity_id").agg(F.min(F.struct("id", "chunk_id")).alias("m")).select("entity_id", F.col("m.chunk_id").alias("chunk_id"))
    texts = chunks.select(F.col("id").alias("chunk_id"), F.substring(F.translate("text", "\n\r", "  "), 1, 220).alias("sample")).join(first.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    samples = first.join(texts, "chunk_id").select(F.col("entity_id").alias("id"), "sample")
    return top.join(samples, "id", "left").select("workspace", "id", "name", "current_type", "count", "sample", "rank")


def resolve_path(artifacts: DataFrame, workspace: str, path: str) -> DataFrame:
    """``id, path`` of the artifact with a path, else of the shortest path that ends in it; at most one row."""
    rows = scoped(current_artifacts(artifacts), workspace).where(F.endswith("path", F.lit(path)))
    return rows.orderBy((F.col("path") == path).desc(), F.length("path"), "path", "id").limit(1).select("id", "path")


def original_place(hits: DataFrame, derived: DataFrame) -> DataFrame:
    """``hits`` (with ``path``) cited by the file they were derived from: ``path``, ``page`` (null if not derived)."""
    pages = derived.select(F.col("derived_path").alias("path"), "orig_path", "page").dropDuplicates(["path"])
    return hits.join(pages, "path", "left").withColumn("path", F.coalesce("orig_path", "path")).drop("orig_path")
