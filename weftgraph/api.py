"""The engine behind one object: each call reads the latest snapshot, and writes the next if it changes anything.

Reading calls return DataFrames (or a dictionary where the answer is one record); writing calls return what was done.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import link, read, render, search, write
from weftgraph.plans import compose, lens
from weftgraph.sources import files
from weftgraph.sources.store import Graph, Store


class Engine:
    """Workspaces, ingest, queries and the write door over a store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    @property
    def graph(self) -> Graph:
        return self.store.read()

    def _save(self, graph: Graph) -> None:
        self.store.write(graph)

    # ---- workspaces and ingest ----

    def create_workspace(self, name: str) -> dict:
        graph = self.graph
        new = graph["workspaces"].where(F.col("name") == name).isEmpty()
        if new:
            self._save(write.create_workspace(graph, name))
        return {"workspace": name, "created": new}

    def list_workspaces(self) -> DataFrame:
        return read.list_workspaces(self.graph["workspaces"], self.graph["artifacts"])

    def list_artifacts(self, workspace: str) -> DataFrame:
        return read.list_artifacts(self.graph["artifacts"], workspace)

    def set_intent(self, workspace: str, intent: str) -> dict:
        self._save(write.set_intent(self.graph, workspace, intent))
        return {"workspace": workspace, "intent": intent}

    def inspect(self, path: str) -> dict:
        return files.inspect(path)

    def ingest(self, path: str, workspace: str = "default", lens: str | None = None, provenance: str = "primary") -> dict:
        graph, counts = compose.ingest(self.graph, path, workspace, lens, provenance)
        self._save(graph)
        return counts

    def clear_synthesized(self, workspace: str) -> dict:
        graph = self.graph
        cleared = write.clear_synthesized(graph, workspace)
        removed = graph["artifacts"].count() - cleared["artifacts"].count()
        self._save(cleared)
        return {"removed": removed}

    # ---- lenses ----

    def list_lenses(self) -> DataFrame:
        return lens.list_lenses(self.graph)

    def get_lens(self, name: str) -> dict | None:
        return lens.get_lens(self.graph, name)

    def register_lens(self, new: lens.Lens) -> dict:
        graph, said = lens.register_lens(self.graph, new)
        if said["ok"]:
            self._save(graph)
        return said

    # ---- typing, writing, resolution ----

    def pending_entities(self, workspace: str, limit: int = 120) -> DataFrame:
        g = self.graph
        return read.pending_entities(g["entities"], g["mentions"], g["chunks"], limit, workspace)

    def classify_entities(self, workspace: str, types: Mapping[str, str]) -> dict:
        """Type or drop provisional entities by name; counts are of names that had one."""
        graph = self.graph
        rows = self.spark.createDataFrame([(workspace, n, t) for n, t in types.items()], "workspace string, name string, type string")
        open_ = graph["entities"].where(read.is_provisional(F.col("props"))).join(rows, ["workspace", "name"]).select("name", "type").distinct()
        counts = {r.d: r.n for r in open_.groupBy((F.col("type") == "drop").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        self._save(write.classify(graph, rows))
        return {"typed": counts.get(False, 0), "dropped": counts.get(True, 0)}

    def add_entity(self, workspace: str, name: str, etype: str, props: dict | None = None, chunk_ids: Sequence[int] = ()) -> dict:
        graph = write.create_workspace(self.graph, workspace)
        row = self.spark.createDataFrame([(workspace, name, etype, json.dumps(props or {}), list(chunk_ids))], "workspace string, name string, etype string, props string, chunk_ids array<long>")
        graph = write.add_entities(graph, row)
        self._save(graph)
        found = self.graph["entities"].where((F.col("workspace") == workspace) & (F.col("name") == name) & (F.col("etype") == etype)).first()
        return {"ok": True, "id": found.id, "name": name, "type": etype}

    def add_relation(self, workspace: str, src: str, dst: str, relation: str, props: dict | None = None, confidence: float = 0.8, asserted: bool = True) -> dict:
        row = self.spark.createDataFrame([(workspace, src, dst, relation, json.dumps(props or {}), confidence, asserted)], "workspace string, src string, dst string, relation string, props string, confidence double, asserted boolean")
        graph, bad = write.add_relations(self.graph, row)
        missing = bad.first()
        if missing is not None:
            return {"ok": False, "error": f"entity not found: {missing.missing}"}
        self._save(graph)
        return {"ok": True, "src": src, "dst": dst, "relation": relation, "asserted": asserted}

    def resolve_entities(self, workspace: str, etype: str | None = None, vectors: DataFrame | None = None, threshold: float = 0.9) -> dict:
        graph, said = compose.alias_merge(self.graph, workspace, {"etype": etype, "vectors": vectors, "threshold": threshold})
        self._save(graph)
        return said

    def merge_entities(self, workspace: str, keep: str, drop: Sequence[str]) -> dict:
        graph, n = write.merge_by_name(self.graph, workspace, keep, drop)
        if n < 0:
            return {"ok": False, "error": f"keep entity not found: {keep}"}
        self._save(graph)
        return {"ok": True, "keep": keep, "merged": n}

    # ---- reading ----

    def overview(self, workspace: str) -> dict | None:
        g = self.graph
        row = read.overview(g["workspaces"], g["artifacts"], g["edges"]).where(F.col("workspace") == workspace).first()
        return None if row is None else row.asDict()

    def search(self, workspace: str, query: str, k: int = 8, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
        g = self.graph
        return search.hybrid_search(g["chunks"], g["artifacts"], g["derived"], query, k, workspace, vectors, query_vector)

    def keyword_search(self, workspace: str, query: str, k: int = 8) -> DataFrame:
        return search.keyword_search(self.graph["chunks"], self.graph["artifacts"], query, k, workspace)

    def cross_edges(self, workspace: str, name: str, min_confidence: float = 0.0) -> DataFrame:
        return read.cross_edges(self.graph["edges"], self.graph["entities"], name, min_confidence, workspace)

    def connections(self, workspace: str, kind: str | None = None, min_confidence: float = 0.0, cross_repo_only: bool = False) -> DataFrame:
        return read.connections(self.graph["edges"], self.graph["artifacts"], kind, min_confidence, cross_repo_only, workspace)

    def binding_candidates(self, workspace: str, kind: str | None = None, limit: int = 25) -> DataFrame:
        """Code endpoints without another side, up to ``limit`` of each role, by kind, key and path."""
        rows = link.unbound(compose.endpoints(self.graph, workspace, with_specs=False))
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        return read.keep_top(rows, ["role"], [F.col("kind"), F.col("key"), F.col("path"), F.col("line")], limit).drop("rank")

    def assert_binding(self, workspace: str, kind: str, key: str, client_path: str, client_line: int, server_path: str, server_line: int, confidence: float = 0.8, rationale: str = "") -> Mapping:
        graph, said = write.assert_binding(self.graph, workspace, kind, key, (client_path, client_line), (server_path, server_line), confidence, rationale)
        if said["ok"]:
            self._save(graph)
        return said

    def entities(self, workspace: str, etype: str | None = None, limit: int = 100) -> DataFrame:
        return read.list_entities(self.graph["entities"], etype, limit, workspace).orderBy("rank")

    def neighbors(self, workspace: str, name: str, relation: str | None = None, etype: str | None = None, limit: int = 50) -> DataFrame:
        return read.neighbors(self.graph["edges"], self.graph["entities"], name, workspace, relation, etype, limit)

    def get_chunk(self, workspace: str, chunk_id: int) -> dict | None:
        row = read.get_chunk(self.graph["chunks"], self.graph["artifacts"], workspace, chunk_id).first()
        return None if row is None else row.asDict()

    def chunks(self, workspace: str, kind: str | None = None, limit: int = 200, offset: int = 0, after: int | None = None) -> DataFrame:
        return read.chunks_page(self.graph["chunks"], self.graph["artifacts"], workspace, kind, limit, offset, after).orderBy("id")

    # ---- rendering ----

    def export_graph(self, workspace: str, cross_repo_only: bool = True) -> str:
        """The flow chart of a workspace's bindings."""
        g = self.graph
        rows = self.connections(workspace, cross_repo_only=cross_repo_only)
        for side in ("client", "server"):
            places = rows.select("workspace", F.col(f"{side}_path").alias("path")).distinct()
            roots = link.root_of(places, g["sources"]).select(F.col("path").alias(f"{side}_path"), F.col("root").alias(f"{side}_root"))
            rows = rows.join(roots, f"{side}_path", "left")
        return render.diagram(rows, workspace)

    def render_artifact(self, folder: str | Path, workspace: str, title: str, body: str, subtitle: str = "") -> Path:
        return render.write_document(folder, workspace, title, body, subtitle)
