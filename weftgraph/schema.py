"""Schemas of the store's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _I, _D, _TS = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TABLES: dict[str, T.StructType] = {
    "workspaces": _schema(name=_S, intent=_S, created_at=_TS),
    "artifacts": _schema(id=_L, workspace=_S, path=_S, kind=_S, lang=_S, sha=_S, lens=_S, props=_S, ingested_at=_TS),
    "chunks": _schema(id=_L, workspace=_S, artifact_id=_L, kind=_S, name=_S, start_line=_I, end_line=_I, text=_S, props=_S),
    "entities": _schema(id=_L, workspace=_S, name=_S, etype=_S, props=_S),
    "mentions": _schema(id=_L, workspace=_S, entity_id=_L, chunk_id=_L, surface=_S),
    "edges": _schema(id=_L, workspace=_S, src_id=_L, dst_id=_L, edge_type=_S, cross_source=_I, confidence=_D, method=_S, provenance=_S, asserted=_I, props=_S, created_at=_TS),
    "sources": _schema(workspace=_S, root_path=_S, added_at=_TS),
    "derived": _schema(workspace=_S, derived_path=_S, orig_path=_S, page=_I),
    "lenses": _schema(name=_S, description=_S, schema=_S, kind=_S, version=_I, frozen=_I, created_at=_TS),
}

#: What makes a row of a table unique; tables not named here are bags.
KEYS = {"workspaces": ["name"], "artifacts": ["workspace", "path"], "entities": ["workspace", "name", "etype"], "sources": ["workspace", "root_path"], "derived": ["workspace", "derived_path"], "lenses": ["name"], "chunks": ["id"]}
