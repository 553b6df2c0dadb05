"""Core queries over the test tables, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import door_queries, graph_queries
from weftgraph.operators import incremental, orphans
from weftgraph.plans.durable import new_path


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of a new sink: up to the last run there is now, published with its watermark and read back."""
    sink = incremental.IncrementalSink(spark, new_path(spark, "sink"))
    return incremental.step(sink, _table(spark, sf, "artifacts"), _table(spark, sf, "run_items"), _table(spark, sf, "ingest_runs"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pending(spark, sf).select("artifact_id")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _pending(spark, sf).select("artifact_id", "workspace", "reason")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    mentions = orphans.references(_table(spark, sf, "mentions"), "mentions", {"entity_id": "entities", "chunk_id": "chunks"})
    edges = orphans.references(_table(spark, sf, "edges"), "edges", {"src_id": "entities", "dst_id": "entities"})
    return mentions.unionByName(edges)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    entities = [_table(spark, sf, t).select("id") for t in ("entities", "late_entities", "shared_entities")]
    return orphans.targets({"entities": entities, "chunks": [_table(spark, sf, "chunks").select("id")]}, _table(spark, sf, "tombstones"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_rows(_references(spark, sf), _targets(spark, sf))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Broken references per table, field and month; a mention's month is that of its chunk's artifact."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    artifacts = incremental.current_versions(_table(spark, sf, "artifacts")).select("artifact_id", month("ingested_at").alias("month"))
    chunks = _table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "artifact_id").groupBy("chunk_id").agg(F.min("artifact_id").alias("artifact_id")).join(artifacts, "artifact_id").select("chunk_id", "month")
    mentions = _table(spark, sf, "mentions").select("id", "entity_id", "chunk_id").distinct().join(chunks, "chunk_id", "left")
    edges = _table(spark, sf, "edges").select("id", "src_id", "dst_id", "created_at").distinct()
    refs = orphans.references(mentions, "mentions", {"entity_id": "entities", "chunk_id": "chunks"}, period=F.col("month")).unionByName(
        orphans.references(edges, "edges", {"src_id": "entities", "dst_id": "entities"}, period=month("created_at"))
    )
    return orphans.orphan_counts(refs, _targets(spark, sf))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return graph_queries.neighbors_part(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_reasons, p5_found, p5_report)} | door_queries.QUERIES


_PATH = r"""array_to_string(list_filter(string_split(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '/'), lambda x: x <> '.'), '/')"""

_PENDING = f"""
WITH cur AS (
  SELECT id AS artifact_id, workspace, {_PATH} AS p, lower(sha) AS s FROM artifacts
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, sha DESC NULLS LAST, path DESC, workspace DESC) = 1
), ok AS (
  SELECT workspace, {_PATH} AS p, lower(sha) AS s, (finished_at, run_id) AS seq FROM run_items JOIN ingest_runs USING (run_id) WHERE status = 'ok'
), last AS (SELECT workspace, p, max(seq) AS seq FROM ok GROUP BY 1, 2),
held AS (SELECT DISTINCT ok.workspace, ok.p, ok.s FROM ok JOIN last ON ok.workspace = last.workspace AND ok.p = last.p AND ok.seq = last.seq WHERE ok.s IS NOT NULL),
judged AS (
  SELECT cur.artifact_id, cur.workspace, CASE WHEN last.seq IS NULL THEN 'new' WHEN cur.s IS NULL THEN 'no_sha' WHEN held.s IS NULL THEN 'changed' END AS reason
  FROM cur LEFT JOIN last ON cur.workspace = last.workspace AND cur.p = last.p
  LEFT JOIN held ON cur.workspace = held.workspace AND cur.p = held.p AND cur.s = held.s
)
"""

_ORPHANS = """
WITH ent AS (
  SELECT id FROM entities UNION SELECT id FROM late_entities UNION SELECT id FROM shared_entities
  EXCEPT SELECT row_id FROM tombstones WHERE table_name = 'entities'
), chu AS (SELECT id FROM chunks EXCEPT SELECT row_id FROM tombstones WHERE table_name = 'chunks')
"""

_MONTHS = """, cur AS (
  SELECT id, strftime(ingested_at, '%Y-%m') AS month FROM artifacts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, sha DESC NULLS LAST) = 1
), m AS (
  SELECT DISTINCT mentions.id, entity_id, chunk_id, month FROM mentions
  LEFT JOIN (SELECT c.id, cur.month FROM (SELECT id, min(artifact_id) AS artifact_id FROM chunks GROUP BY id) c JOIN cur ON cur.id = artifact_id) c ON c.id = chunk_id
), e AS (SELECT DISTINCT id, src_id, dst_id, strftime(created_at, '%Y-%m') AS month FROM edges),
refs AS (
  SELECT 'mentions' AS table_name, 'entity_id' AS field_name, month AS period, entity_id IN (SELECT id FROM ent) AS there FROM m WHERE entity_id IS NOT NULL
  UNION ALL SELECT 'mentions', 'chunk_id', month, chunk_id IN (SELECT id FROM chu) FROM m WHERE chunk_id IS NOT NULL
  UNION ALL SELECT 'edges', 'src_id', month, src_id IN (SELECT id FROM ent) FROM e WHERE src_id IS NOT NULL
  UNION ALL SELECT 'edges', 'dst_id', month, dst_id IN (SELECT id FROM ent) FROM e WHERE dst_id IS NOT NULL
)
SELECT table_name, field_name, period, count(*) AS n_refs, count(*) FILTER (NOT there) AS n_orphans FROM refs GROUP BY 1, 2, 3
"""


def oracle_sql() -> dict[str, str]:
    return door_queries.SQL | {
        "p1_found": _PENDING + "SELECT artifact_id FROM judged WHERE reason IS NOT NULL",
        "p1_reasons": _PENDING + "SELECT artifact_id, workspace, reason FROM judged WHERE reason IS NOT NULL",
        "p5_found": _ORPHANS + """
SELECT DISTINCT 'mentions' AS table_name, 'entity_id' AS field_name, id AS row_id FROM mentions WHERE entity_id NOT IN (SELECT id FROM ent)
UNION ALL SELECT DISTINCT 'mentions', 'chunk_id', id FROM mentions WHERE chunk_id NOT IN (SELECT id FROM chu)
UNION ALL SELECT DISTINCT 'edges', 'src_id', id FROM edges WHERE src_id NOT IN (SELECT id FROM ent)
UNION ALL SELECT DISTINCT 'edges', 'dst_id', id FROM edges WHERE dst_id NOT IN (SELECT id FROM ent)""",
        "p5_report": _ORPHANS + _MONTHS,
    }
