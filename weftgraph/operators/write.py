"""Write side: mutations as functions from tables to tables.

Nothing is updated in place; the result replaces the table in the next snapshot.  Ids of
new rows are hashes of what makes them unique, so running a mutation twice changes
nothing where the reference semantics ask for that, and adds rows where they say append.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.text import stable_id
from weftgraph.operators.link import entity_id, root_of
from weftgraph.operators.read import count_of, is_provisional, resolve_path, typed_bindings
from weftgraph.operators.resolve import canonical_map, repoint
from weftgraph.plans.durable import durable
from weftgraph.schema import KEYS
from weftgraph.sources.store import Graph, conform


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` and those rows of ``incoming`` whose key it lacks, one for each key (nulls are equal)."""
    return existing.unionByName(missing_rows(existing, incoming, keys))


def missing_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Those rows of ``incoming`` whose key ``existing`` lacks, one for each key (nulls are equal)."""
    fresh = incoming.dropDuplicates(list(keys)).alias("n")
    old = existing.select(*keys).distinct().alias("o")
    return fresh.join(old, _all_equal(keys), "left_anti")


def free_ids(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``fresh`` (distinct keys, new to ``existing``), written, with ids that no other row has.

    Ids are hashes; a row whose id another key holds, in either table, gets the hash of id and key instead.
    """
    key = F.struct(*keys)
    while True:
        fresh = durable(fresh, "fresh")
        first = fresh.groupBy("id").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        marked = fresh.join(first, "id", "left").join(existing.select("id", F.lit(True).alias("_taken")).distinct(), "id", "left")
        clash = F.coalesce(F.col("_taken"), F.col("_first").isNotNull() & ~key.eqNullSafe(F.col("_first")), F.lit(False))
        if marked.where(clash).isEmpty():
            return fresh
        fresh = marked.withColumn("id", F.when(clash, stable_id("id", *keys)).otherwise(F.col("id"))).select(*fresh.columns)


def upsert_into(graph: Graph, table: str, incoming: DataFrame, keep: Sequence[str] = ("id",)) -> Graph:
    """The graph with rows upserted by the table's key; where no key is there yet they are only appended."""
    keys = KEYS[table]
    rows = conform(incoming, table)
    known = graph[table].alias("n").join(rows.select(*keys).distinct().alias("o"), _all_equal(keys), "left_semi")
    if known.isEmpty():
        return graph.append(table, free_ids(graph[table], rows.dropDuplicates(list(keys)), keys))
    return graph.with_tables(**{table: upsert(graph[table], rows, keys, keep=keep)})


def without_rows(graph: Graph, table: str, ids: DataFrame, column: str = "id") -> Graph:
    """The graph without rows whose ``column`` is among ``ids.id``; a table that has none stays as it is written."""
    hit = graph[table].join(ids.select(F.col("id").alias("_gone")).distinct(), F.col(column) == F.col("_gone"), "left_semi")
    return graph if hit.isEmpty() else graph.with_tables(**{table: without_ids(graph[table], ids, column)})


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """Rows of both, where a key of ``incoming`` replaces the rows of ``existing`` except for the columns ``keep`` (of several the smallest).

    Of several incoming rows of a key the last in ``order`` counts (any, without an order).
    """
    if order:
        last = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
        fresh = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    else:
        fresh = incoming.dropDuplicates(list(keys))
    same = _all_equal(keys)
    if keep:
        old = existing.groupBy(*keys).agg(F.min(F.struct(*keep)).alias("_old")).select(*keys, *[F.col(f"_old.{c}").alias(f"_{c}") for c in keep]).alias("o")
        fresh = fresh.alias("n").join(old, same, "left").select(*[(F.coalesce(F.col(f"_{c}"), F.col(f"n.{c}")) if c in keep else F.col(f"n.{c}")).alias(c) for c in incoming.columns])
    rest = existing.alias("n").join(fresh.select(*keys).alias("o"), same, "left_anti")
    return rest.unionByName(fresh, allowMissingColumns=True).select(*existing.columns)


def _all_equal(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return same


def without_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``ids.id``; null never is."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return df.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def remove_entities(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without some entities, their mentions and the edges at them."""
    if ids.isEmpty():
        return graph
    for table, column in (("edges", "src_id"), ("edges", "dst_id"), ("mentions", "entity_id"), ("entities", "id")):
        graph = without_rows(graph, table, ids, column)
    return graph


def clear_origin(graph: Graph, workspace: str, origin: str) -> Graph:
    """Drop what an extractor produced: entities of that origin with mentions and edges."""
    ids = graph["entities"].where((F.col("workspace") == workspace) & (T.json_text(F.col("props"), "$.origin") == origin)).select("id")
    return remove_entities(graph, durable(ids, "cleared"))


def create_workspace(graph: Graph, name: str, intent: str | None = None) -> Graph:
    """Add a workspace unless it exists."""
    row = graph.spark.createDataFrame([(name, intent)], "name string, intent string").withColumn("created_at", F.current_timestamp())
    return graph if not graph["workspaces"].where(F.col("name") == name).isEmpty() else graph.append("workspaces", row)


def set_intent(graph: Graph, name: str, intent: str) -> Graph:
    """Record what the workspace is to answer; creates it if needed."""
    made = create_workspace(graph, name)
    return made.with_tables(workspaces=made["workspaces"].withColumn("intent", F.when(F.col("name") == name, F.lit(intent)).otherwise(F.col("intent"))))


def add_source(graph: Graph, workspace: str, root: str) -> Graph:
    row = graph.spark.createDataFrame([(workspace, root.rstrip("/") or "/")], "workspace string, root_path string").withColumn("added_at", F.current_timestamp())
    return graph if not graph["sources"].join(row.select("workspace", "root_path"), ["workspace", "root_path"], "left_semi").isEmpty() else graph.append("sources", row)


def upsert_artifacts(graph: Graph, incoming: DataFrame) -> Graph:
    """Add or replace artifacts by workspace and path.

    The id stays; old chunks of replaced artifacts go, with their mentions and the
    artifacts' connector edges.  New artifacts get an id from workspace and path.  Where
    nothing is replaced, rows are only appended.
    """
    rows = incoming.withColumn("id", stable_id("workspace", "path"))
    keys = KEYS["artifacts"]
    hit = durable(graph["artifacts"].alias("n").join(rows.select(*keys).distinct().alias("o"), _all_equal(keys), "left_semi").select("id").distinct(), "replaced")
    if hit.isEmpty():
        return graph.append("artifacts", free_ids(graph["artifacts"], conform(rows, "artifacts").dropDuplicates(list(keys)), keys))
    gone = durable(graph["chunks"].join(hit.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").select("id").distinct(), "gone")
    at = T.json_int(F.col("props"), "$.artifact_id")
    connectors = durable(graph["edges"].where("edge_type = 'connector'").select("id", at.alias("_a")).join(hit.select(F.col("id").alias("_a")), "_a", "left_semi").select("id"), "connectors")
    graph = graph.with_tables(artifacts=upsert(graph["artifacts"], conform(rows, "artifacts"), keys, keep=["id", "lens", "props"]))
    return without_rows(without_rows(without_rows(graph, "chunks", gone), "mentions", gone, "chunk_id"), "edges", connectors)


def stamp(artifacts: DataFrame, workspace: str, root: str, lens: str | None, provenance: str) -> DataFrame:
    """Artifacts below ``root`` with lens and provenance set.  A sibling that only shares the root's letters is not below it."""
    base = root.rstrip("/")
    below = (F.col("workspace") == workspace) & ((F.col("path") == base) | F.startswith("path", F.lit(base + "/")))
    with_it = T.with_field(F.col("props"), "provenance", F.lit(f'"{provenance}"'))
    out = artifacts.withColumn("props", F.when(below, with_it).otherwise(F.col("props")))
    return out if lens is None else out.withColumn("lens", F.when(below, F.lit(lens)).otherwise(F.col("lens")))


def stamp_below(graph: Graph, workspace: str, root: str, lens: str | None, provenance: str) -> Graph:
    """The graph with :func:`stamp` applied, if any artifact below the root says otherwise."""
    rows = graph["artifacts"]
    marked = stamp(rows, workspace, root, lens, provenance)
    base = root.rstrip("/")
    below = (F.col("workspace") == workspace) & ((F.col("path") == base) | F.startswith("path", F.lit(base + "/")))
    differs = ~T.json_text(F.col("props"), "$.provenance").eqNullSafe(F.lit(provenance))
    differs = differs if lens is None else differs | ~F.col("lens").eqNullSafe(F.lit(lens))
    return graph if rows.where(below & differs).isEmpty() else graph.with_tables(artifacts=marked)


def clear_synthesized(graph: Graph, workspace: str | None = None) -> Graph:
    """Drop artifacts of provenance ``synthesized`` with their chunks and mentions; entities and edges stay."""
    rows = graph["artifacts"].where(T.json_text(F.col("props"), "$.provenance") == "synthesized")
    if workspace is not None:
        rows = rows.where(F.col("workspace") == workspace)
    ids = durable(rows.select("id"), "synthesized")
    gone = graph["chunks"].join(ids.select(F.col("id").alias("artifact_id")).distinct(), "artifact_id", "left_semi").select("id")
    return without_rows(without_rows(without_rows(graph, "mentions", gone, "chunk_id"), "chunks", gone), "artifacts", ids)


def classify(graph: Graph, types: DataFrame) -> Graph:
    """Give provisional entities their type, or drop them.

    ``types`` has ``workspace, name, type``; type ``drop`` removes the entities with
    mentions and edges, any other becomes their type and they are provisional no more.
    An entity whose new type an entity of that name already has is folded into that one.
    """
    said = types.select(F.col("workspace"), "name", F.col("type").alias("_type")).dropDuplicates(["workspace", "name"])
    marked = graph["entities"].join(said, ["workspace", "name"], "left").withColumn("_type", F.when(is_provisional(F.col("props")), F.col("_type")))
    dropped = marked.where("_type = 'drop'").select("id")
    kept = marked.where("_type is null or _type <> 'drop'")
    typed = kept.withColumn("props", F.when(F.col("_type").isNotNull(), T.without_field(F.col("props"), "provisional")).otherwise(F.col("props"))).withColumn("etype", F.coalesce("_type", "etype"))
    graph = remove_entities(graph, dropped).with_tables(entities=typed)
    order = Window.partitionBy("workspace", "name", "etype").orderBy(F.col("_type").isNotNull(), "id")
    clash = typed.withColumn("_first", F.first("id").over(order)).where("id <> _first").select(F.col("id").alias("old_id"), F.col("_first").alias("new_id"))
    return fuse(graph, clash)


def add_entities(graph: Graph, rows: DataFrame) -> Graph:
    """Add or replace entities by hand: ``workspace, name, etype, props, chunk_ids``; origin is ``extracted`` unless props say otherwise.

    Each listed chunk gets a mention, each time.
    """
    has_origin = F.map_contains_key(T.json_fields(F.col("props")), "origin")
    full = F.when(has_origin, F.col("props")).otherwise(T.with_field(F.col("props"), "origin", F.lit('"extracted"')))
    new = rows.withColumn("props", full).withColumn("id", entity_id(F.col("workspace"), F.col("name"), F.col("etype")))
    graph = upsert_into(graph, "entities", new)
    ids = graph["entities"].select("workspace", "name", "etype", F.col("id").alias("entity_id"))
    said = new.select("workspace", "name", "etype", F.explode("chunk_ids").alias("chunk_id")).join(ids, ["workspace", "name", "etype"])
    mentions = said.select(F.expr("xxhash64(uuid())").alias("id"), "workspace", "entity_id", "chunk_id", F.col("name").alias("surface"))
    return graph if said.isEmpty() else graph.append("mentions", mentions)


def best_known(entities: DataFrame) -> DataFrame:
    """``workspace, name, id``: for each name the entity with the largest count, then the smallest id."""
    order = F.struct(F.coalesce(count_of(F.col("props")), F.lit(0.0)), -F.col("id"))
    return entities.where("id is not null and name is not null").groupBy("workspace", "name").agg(F.max_by("id", order).alias("id"))


def add_relations(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Append claims between entities by name: ``workspace, src, dst, relation, props, confidence, asserted``.

    Returns the graph and the rows that name an unknown entity, with ``missing``.  Claims
    are not made distinct; a claim that is only reported has ``asserted`` false.
    """
    known = best_known(graph["entities"])
    found = rows.join(known.select("workspace", F.col("name").alias("src"), F.col("id").alias("src_id")), ["workspace", "src"], "left").join(known.select("workspace", F.col("name").alias("dst"), F.col("id").alias("dst_id")), ["workspace", "dst"], "left")
    bad = found.where("src_id is null or dst_id is null").select(*rows.columns, F.when(F.col("src_id").isNull(), F.col("src")).otherwise(F.col("dst")).alias("missing"))
    good = found.where("src_id is not null and dst_id is not null").select(
        F.expr("xxhash64(uuid())").alias("id"), "workspace", "src_id", "dst_id", F.col("relation").alias("edge_type"), F.lit(0).alias("cross_source"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
        F.lit("extracted").alias("method"), F.coalesce(F.col("asserted").cast("int"), F.lit(1)).alias("asserted"), F.coalesce("props", F.lit("{}")).alias("props"), F.current_timestamp().alias("created_at"),
    )
    return graph.append("edges", good), bad


def fuse(graph: Graph, merges: DataFrame) -> Graph:
    """Fold entities into others (``old_id, new_id``): mentions and edges follow, names become aliases, the folded go.

    Edges are neither made distinct nor freed of loops, counts are not added up.
    """
    if merges.isEmpty():
        return graph
    entities = graph["entities"]
    none = F.array().cast("array<string>")
    aliases = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.aliases", "array<string>"), none)
    gone = merges.join(entities.select(F.col("id").alias("old_id"), "name", aliases.alias("aliases")), "old_id")
    more = gone.groupBy(F.col("new_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), "aliases")))).alias("_more"))
    rest = without_ids(entities, merges.select(F.col("old_id").alias("id"))).join(more, "id", "left")
    every = F.to_json(F.array_sort(F.array_union(aliases, "_more")))
    folded = rest.withColumn("props", F.when(F.col("_more").isNotNull(), T.with_field(F.col("props"), "aliases", every)).otherwise(F.col("props")))
    edges = repoint(repoint(graph["edges"], merges, "src_id"), merges, "dst_id")
    return graph.with_tables(entities=folded, mentions=repoint(graph["mentions"], merges, "entity_id"), edges=edges)


def merge_by_name(graph: Graph, workspace: str, keep: str, drop: Sequence[str]) -> tuple[Graph, int]:
    """Fold the best known entity of each dropped name into that of ``keep``; unknown names are passed over.

    Returns the graph and how many were folded (-1 if ``keep`` is unknown).
    """
    ids = {r.name: r.id for r in best_known(graph["entities"]).where((F.col("workspace") == workspace) & F.col("name").isin(keep, *drop)).collect()}
    if keep not in ids:
        return graph, -1
    pairs = [(ids[n], ids[keep]) for n in dict.fromkeys(drop) if n in ids and ids[n] != ids[keep]]
    return fuse(graph, graph.spark.createDataFrame(pairs, "old_id long, new_id long")), len(pairs)


def resolve_aliases(graph: Graph, groups: DataFrame) -> Graph:
    """Fold each group of entities (``id, group_id``) into its canonical one."""
    return fuse(graph, canonical_map(groups, graph["entities"], graph["mentions"]))


def assert_binding(graph: Graph, workspace: str, kind: str, key: str, client: tuple[str, int], server: tuple[str, int], confidence: float = 0.8, rationale: str = "") -> tuple[Graph, Mapping]:
    """Record a binding that was reasoned out; it replaces an earlier one of the same key and artifacts.

    Paths may be given by their end.  Returns the graph and what was done.
    """
    spark = graph.spark
    found = {}
    for side, path in (("client", client[0]), ("server", server[0])):
        row = resolve_path(graph["artifacts"], workspace, path).first()
        if row is None:
            return graph, {"ok": False, "error": f"artifact not found in workspace: {path}"}
        found[side] = row
    places = spark.createDataFrame([(workspace, found["client"].path), (workspace, found["server"].path)], "workspace string, path string")
    roots = {r.path: r.root for r in root_of(places, graph["sources"]).collect()}
    a, b = roots.get(found["client"].path), roots.get(found["server"].path)
    cross = int(bool(a and b and a != b))
    old = typed_bindings(graph["edges"]).where((F.col("workspace") == workspace) & (F.col("method") == "llm") & (F.col("kind") == kind) & (F.col("key") == key) & (F.col("client_artifact") == found["client"].id) & (F.col("server_artifact") == found["server"].id)).select("id")
    props = F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.lit(found["client"].id).alias("client_artifact"), F.lit(client[1]).alias("client_line"), F.lit(found["server"].id).alias("server_artifact"), F.lit(server[1]).alias("server_line"), F.lit(cross).alias("cross_repo")))
    why = F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.lit(rationale).alias("rationale")))
    row = spark.range(1).select(
        stable_id(F.lit(workspace), F.lit(kind), F.lit(key), F.lit(found["client"].id), F.lit(found["server"].id), F.lit("llm")).alias("id"), F.lit(workspace).alias("workspace"), F.lit("binding").alias("edge_type"),
        F.lit(0).alias("cross_source"), F.lit(confidence).alias("confidence"), F.lit("llm").alias("method"), why.alias("provenance"), F.lit(1).alias("asserted"), props.alias("props"), F.current_timestamp().alias("created_at"),
    )
    return without_rows(graph, "edges", durable(old, "asserted")).append("edges", row), {"ok": True, "kind": kind, "key": key, "cross_repo": cross, "confidence": confidence}
