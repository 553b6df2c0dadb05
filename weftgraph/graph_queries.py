"""Queries of the graph operators over the test tables, each with the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import patterns as P
from weftgraph.functions import text as T
from weftgraph.functions.paths import base_name, suffix
from weftgraph.operators import extract, link, read, render, resolve, search, write
from weftgraph.plans.durable import durable
from weftgraph.sources import files
from weftgraph.sources.store import Graph
from weftgraph.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [_table(spark, sf, n) for n in names]


def _q(s: str) -> str:
    return s.replace("'", "''")


#: Views that the SQL builds on: artifacts in their current version, chunks, entities and edges once each.
_ART = "art AS (SELECT * REPLACE (lower(trim(kind)) AS kind) FROM artifacts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, sha DESC NULLS LAST, path DESC, workspace DESC) = 1)"
_CHU = "chu AS (SELECT DISTINCT id, workspace, artifact_id, kind, name, text, start_line, end_line FROM chunks)"
_ENT = "ent AS (SELECT DISTINCT id, workspace, name, etype, props FROM entities)"
_EDG = "edg AS (SELECT DISTINCT * FROM edges)"


def _json(field: str, column: str = "props") -> str:
    return f"CASE WHEN json_valid({column}) THEN json_extract_string({column}, '$.{field}') END"


# ---- parts that are ordered together: the flagship ----

_PARTS = """
WITH base AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pairs AS (SELECT a.p AS src_id, b.p AS dst_id, count(*) AS shared FROM base a JOIN base b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2),
edge AS (SELECT *, least(1.0::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * shared) AS confidence FROM pairs)
"""


def _part_edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = _table(spark, sf, "lineitem")
    mentions = lines.select(F.lit("orders").alias("workspace"), F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))
    chunks = lines.select(F.col("l_orderkey").alias("id"), F.lit(None).cast("string").alias("name"))
    return link.cooccurrence(mentions, chunks)


@query(_PARTS + "SELECT src_id, dst_id, shared, round(confidence, 6) AS confidence FROM edge")
def cooccur_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _part_edges(spark, sf).select("src_id", "dst_id", "shared", F.round("confidence", 6).alias("confidence"))


@query(_PARTS + """, both_ways AS (SELECT src_id AS part, dst_id AS other, shared, confidence FROM edge UNION ALL SELECT dst_id, src_id, shared, confidence FROM edge)
SELECT part, other, p_name AS other_name, shared, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY shared DESC, confidence DESC, other) AS rank FROM both_ways) JOIN part p ON p.p_partkey = other WHERE rank <= 10""")
def neighbors_part(spark: SparkSession, sf: str) -> DataFrame:
    edges = _part_edges(spark, sf)
    both = edges.select(F.col("src_id").alias("part"), F.col("dst_id").alias("other"), "shared", "confidence").unionByName(edges.select(F.col("dst_id").alias("part"), F.col("src_id").alias("other"), "shared", "confidence"))
    top = resolve.keep_top(both, ["part"], [F.col("shared").desc(), F.col("confidence").desc(), F.col("other")], 10)
    names = _table(spark, sf, "part").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("other_name"))
    return top.join(names, "other").select("part", "other", "other_name", "shared", "rank")


# ---- reading the graph ----

_KINDS = """kinds AS (
  SELECT workspace, sum(n)::BIGINT AS artifacts, string_agg(coalesce(kind, '') || '=' || n, ',' ORDER BY kind NULLS FIRST) AS by_kind
  FROM (SELECT workspace, kind, count(*) AS n FROM art GROUP BY ALL) GROUP BY workspace)"""


@query(f"WITH {_ART}, {_KINDS} SELECT DISTINCT name, created_at, coalesce(artifacts, 0) AS artifacts, coalesce(by_kind, '') AS by_kind FROM workspaces LEFT JOIN kinds ON name = workspace")
def list_workspaces(spark: SparkSession, sf: str) -> DataFrame:
    return read.list_workspaces(*_tables(spark, sf, "workspaces", "artifacts"))


@query(f"WITH {_ART} SELECT a.workspace, a.id, a.path, o.kind, a.lang, a.lens, {_json('provenance', 'a.props')} AS provenance, a.ingested_at FROM art a JOIN (SELECT DISTINCT id, ingested_at, sha, path, kind FROM artifacts) o ON o.id = a.id AND o.ingested_at = a.ingested_at AND o.sha IS NOT DISTINCT FROM a.sha AND o.path = a.path")
def list_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return read.list_artifacts(_table(spark, sf, "artifacts"))


@query(f"""WITH {_ART}, {_CHU} SELECT c.workspace, c.id, c.kind, c.name, c.start_line, c.end_line, a.path, a.kind AS artifact_kind, substr(c.text, 1, 400) AS preview
FROM chu c JOIN art a ON a.id = c.artifact_id QUALIFY row_number() OVER (PARTITION BY c.workspace ORDER BY c.id) BETWEEN 51 AND 250""")
def chunks_page(spark: SparkSession, sf: str) -> DataFrame:
    return read.chunks_page(*_tables(spark, sf, "chunks", "artifacts"), limit=200, offset=50)


@query(f"""WITH {_ART}, {_CHU} SELECT c.id, c.workspace, c.artifact_id, c.kind, c.name, c.text, a.path, a.kind AS artifact_kind FROM chu c JOIN art a ON a.id = c.artifact_id
WHERE c.id = (SELECT max(id) FROM chunks) AND c.workspace = (SELECT any_value(workspace) FROM chunks WHERE id = (SELECT max(id) FROM chunks))""")
def get_chunk(spark: SparkSession, sf: str) -> DataFrame:
    chunks, artifacts = _tables(spark, sf, "chunks", "artifacts")
    last = chunks.groupBy().agg(F.max(F.struct("id", "workspace")).alias("m")).first().m
    return read.get_chunk(chunks, artifacts, last.workspace, last.id).select("id", "workspace", "artifact_id", "kind", "name", "text", "path", "artifact_kind")


@query(f"""WITH {_ART}, {_KINDS}, {_EDG}, sums AS (
  SELECT workspace, count(*) FILTER (cross_source = 1) AS cross_source_edges, count(*) FILTER (edge_type = 'binding') AS structural_bindings,
    coalesce(sum(CASE WHEN edge_type = 'binding' THEN TRY_CAST({_json('cross_repo')} AS BIGINT) END), 0)::BIGINT AS cross_repo_bindings FROM edg GROUP BY workspace)
SELECT DISTINCT name AS workspace, intent, coalesce(by_kind, '') AS artifacts_by_kind, coalesce(cross_source_edges, 0) AS cross_source_edges, coalesce(structural_bindings, 0) AS structural_bindings, coalesce(cross_repo_bindings, 0) AS cross_repo_bindings
FROM workspaces LEFT JOIN kinds ON kinds.workspace = name LEFT JOIN sums ON sums.workspace = name""")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return read.overview(*_tables(spark, sf, "workspaces", "artifacts", "edges"))


@query(f"""WITH {_ENT}, {_EDG} SELECT e.workspace, e.id, e.edge_type, e.confidence, e.method, e.asserted, s.name AS src, s.etype AS src_type, d.name AS dst, d.etype AS dst_type
FROM edg e JOIN ent s ON s.id = e.src_id JOIN ent d ON d.id = e.dst_id WHERE e.cross_source = 1 AND e.confidence >= 0.6""")
def cross_edges_conf(spark: SparkSession, sf: str) -> DataFrame:
    return read.cross_edges(*_tables(spark, sf, "edges", "entities"), min_confidence=0.6)


_BIND = f"""bound AS (SELECT id, workspace, confidence, method, {_json('kind')} AS kind, {_json('key')} AS key, TRY_CAST({_json('cross_repo')} AS BIGINT) AS cross_repo,
  TRY_CAST({_json('client_artifact_id')} AS BIGINT) AS ca, TRY_CAST({_json('client_line')} AS BIGINT) AS client_line, TRY_CAST({_json('server_artifact_id')} AS BIGINT) AS sa, TRY_CAST({_json('server_line')} AS BIGINT) AS server_line
  FROM edg WHERE edge_type = 'binding')"""


@query(f"""WITH {_ART}, {_EDG}, {_BIND} SELECT b.workspace, b.id, b.kind, b.key, b.cross_repo, b.confidence, b.method, x.path AS client_path, b.client_line, y.path AS server_path, b.server_line
FROM bound b JOIN art x ON x.id = ca JOIN art y ON y.id = sa WHERE b.confidence >= 0""")
def connections(spark: SparkSession, sf: str) -> DataFrame:
    return read.connections(*_tables(spark, sf, "edges", "artifacts"))


@query(f"""WITH {_ENT} SELECT workspace, id, name, etype AS type, TRY_CAST({_json('count')} AS DOUBLE) AS count, TRY_CAST({_json('first_page')} AS BIGINT) AS first_page,
  row_number() OVER (PARTITION BY workspace ORDER BY coalesce(TRY_CAST({_json('count')} AS DOUBLE), 0) DESC, name, id) AS rank FROM ent QUALIFY rank <= 100""")
def entities_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return read.list_entities(_table(spark, sf, "entities"))


_SEEN = f"""live AS (SELECT *, TRY_CAST({_json('shared')} AS DOUBLE) AS weight FROM edg WHERE src_id IS NOT NULL AND dst_id IS NOT NULL),
seen AS (SELECT workspace, id AS edge_id, src_id AS entity_id, dst_id AS other_id, edge_type AS relation, weight, confidence, true AS fwd FROM live
  UNION ALL SELECT workspace, id, dst_id, src_id, edge_type, weight, confidence, false FROM live WHERE src_id <> dst_id)"""
_STRENGTH = "coalesce(nullif(weight, 0), nullif(confidence, 0), 0)"


@query(f"""WITH {_ENT}, {_EDG}, {_SEEN} SELECT s.workspace, entity_id, other_id, o.name AS entity, o.etype AS type, relation, weight, confidence,
  row_number() OVER (PARTITION BY entity_id ORDER BY {_STRENGTH} DESC, o.name NULLS FIRST, relation NULLS FIRST, edge_id) AS rank
FROM seen s JOIN ent o ON o.id = other_id WHERE entity_id IN (SELECT id FROM ent) QUALIFY rank <= 50""")
def neighbors_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return read.ranked_neighbors(*_tables(spark, sf, "edges", "entities"))


_BUSY = "(SELECT name FROM edg JOIN ent ON ent.id IN (src_id, dst_id) WHERE edge_type = 'co_occurs' GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


@query(f"""WITH {_ENT}, {_EDG}, {_SEEN} SELECT s.workspace, o.name AS entity, o.etype AS type, relation, weight, confidence
FROM seen s JOIN ent o ON o.id = other_id JOIN ent e ON e.id = entity_id WHERE relation = 'co_occurs' AND e.name = {_BUSY} AND (fwd OR o.name IS DISTINCT FROM {_BUSY})
ORDER BY {_STRENGTH} DESC, entity, relation, edge_id LIMIT 50""")
def neighbors_named(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the name with most co-occurrences."""
    edges, entities = _tables(spark, sf, "edges", "entities")
    ends = edges.where("edge_type = 'co_occurs'").distinct().select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("id"))
    busy = ends.join(entities.select("id", "name").distinct(), "id").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").first()
    return read.neighbors(edges, entities, busy.name if busy else "", relation="co_occurs").select("workspace", "entity", "type", "relation", "weight", "confidence")


@query(f"""WITH {_ENT}, {_CHU}, top AS (
  SELECT workspace, id, name, etype AS current_type, TRY_CAST({_json('count')} AS DOUBLE) AS count,
    row_number() OVER (PARTITION BY workspace ORDER BY coalesce(TRY_CAST({_json('count')} AS DOUBLE), 0) DESC, name, id) AS rank
  FROM ent WHERE {_json('provisional')} IN ('true', '1') QUALIFY rank <= 120),
first AS (SELECT entity_id, (min(struct_pack(i := m.id, c := m.chunk_id))).c AS chunk_id FROM mentions m WHERE chunk_id IN (SELECT id FROM chu) GROUP BY 1)
SELECT t.workspace, t.id, t.name, current_type, count, substr(replace(replace(c.text, chr(10), ' '), chr(13), ' '), 1, 220) AS sample, rank
FROM top t LEFT JOIN first f ON f.entity_id = t.id LEFT JOIN chu c ON c.id = f.chunk_id""")
def pending_entities(spark: SparkSession, sf: str) -> DataFrame:
    return read.pending_entities(*_tables(spark, sf, "entities", "mentions", "chunks"))


@query(f"""WITH {_ART}, {_CHU} SELECT c.workspace, c.id, c.kind, c.name, c.start_line, c.end_line, a.path, a.kind AS artifact_kind, substr(c.text, 1, 600) AS preview
FROM chu c JOIN art a ON a.id = c.artifact_id
WHERE translate(c.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%harbor%' OR translate(c.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%harbor%'
QUALIFY row_number() OVER (PARTITION BY c.workspace ORDER BY c.id) <= 8""")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.keyword_search(*_tables(spark, sf, "chunks", "artifacts"), query="HARBOR")


@query(f"WITH {_ART} SELECT id, path FROM art WHERE workspace = (SELECT min(name) FROM workspaces) AND path LIKE '%/index.js' ORDER BY length(path), path, id LIMIT 1")
def resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    first = _table(spark, sf, "workspaces").agg(F.min("name")).first()[0]
    return read.resolve_path(_table(spark, sf, "artifacts"), first, "/index.js")


# ---- surfacing ----

_TEXTS = f"{_ART}, {_CHU}, txt AS (SELECT c.workspace, c.id AS chunk_id, c.artifact_id, c.name, regexp_replace(c.text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g') AS text FROM chu c JOIN art a ON a.id = c.artifact_id WHERE a.kind IN ('docs', 'pdf', 'spec'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in P.NOT_NAMES) + "]"
_NOUNS = f"""{_TEXTS}, cand AS (
  SELECT workspace, chunk_id, name AS chunk_name, unnest(f) AS name, generate_subscripts(f, 1) AS pos FROM (
    SELECT *, list_filter(regexp_extract_all(text, '{_q(P.PROPER_NOUN)}', 1), lambda t: NOT list_contains({_STOP}, regexp_split_to_array(t, '\\s+')[1])) AS f
    FROM txt WHERE artifact_id IN (SELECT id FROM art WHERE kind IN ('docs', 'pdf'))))
, nouns AS (
  SELECT workspace, name, count(*) AS count, min(struct_pack(c := chunk_id, p := pos)) AS first,
    arg_min(TRY_CAST(substr(chunk_name, 2) AS INTEGER), struct_pack(c := chunk_id, p := pos)) FILTER (regexp_full_match(chunk_name, 'p[0-9]+')) AS first_page
  FROM cand GROUP BY ALL HAVING count(*) >= 4)
, top AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY count DESC, first) AS rank FROM nouns QUALIFY rank <= 60)"""


def _texts(spark: SparkSession, sf: str, kinds: tuple[str, ...] = extract.TEXT_KINDS) -> DataFrame:
    return extract.text_chunks(*_tables(spark, sf, "chunks", "artifacts"), kinds)


@query(f"WITH {_NOUNS} SELECT workspace, name, count, first_page, rank FROM top")
def proper_nouns(spark: SparkSession, sf: str) -> DataFrame:
    return extract.proper_noun_counts(_texts(spark, sf, ("docs", "pdf")))


@query(f"WITH {_NOUNS} SELECT DISTINCT cand.workspace, cand.name, chunk_id FROM cand JOIN top USING (workspace, name)")
def proper_noun_mentions(spark: SparkSession, sf: str) -> DataFrame:
    chunks = durable(_texts(spark, sf, ("docs", "pdf")), "texts")
    return extract.proper_noun_mentions(chunks, extract.proper_noun_counts(chunks))


_FUNCTION = "[" + ", ".join(f"'{w}'" for w in P.FUNCTION_WORDS) + "]"


@query(f"""WITH {_TEXTS}, toks AS (
  SELECT workspace, chunk_id, list_transform(regexp_extract_all(text, '{_q(P.PHRASE_TOKEN)}', 1), lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z]{{3,}}') AND NOT list_contains({_FUNCTION}, lower(t)) THEN t ELSE '|' END) AS w FROM txt)
, runs AS (SELECT workspace, chunk_id, list_filter(list_transform(string_split(array_to_string(w, ' '), '|'), lambda r: list_filter(string_split(r, ' '), lambda x: x <> '')), lambda r: len(r) > 0) AS runs FROM toks)
, grams AS (
  SELECT workspace, chunk_id, flatten(list_transform(runs, lambda r: flatten(list_transform(list_filter([1, 2, 3], lambda n: n <= len(r)),
    lambda n: list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' ')))))) AS g FROM runs)
, cand AS (SELECT workspace, chunk_id, unnest(g) AS name, generate_subscripts(g, 1) AS pos FROM grams)
, terms AS (SELECT workspace, lower(name) AS term, count(*) AS count, min(struct_pack(c := chunk_id, p := pos, n := name)) AS first FROM cand GROUP BY ALL HAVING count(*) >= 4)
SELECT workspace, (first).n AS name, term, count, row_number() OVER (PARTITION BY workspace ORDER BY count DESC, first) AS rank FROM terms QUALIFY rank <= 80""")
def salient_terms(spark: SparkSession, sf: str) -> DataFrame:
    return extract.salient_term_counts(_texts(spark, sf))


def _matches_sql(forms: list[str]) -> str:
    parts = []
    for k, form in enumerate(forms):
        flags, body = ("", form) if not form.startswith("(?") or form[2] == ":" else (form[: form.index(")") + 1], form[form.index(")") + 1 :])
        whole = _q(f"{flags}({body})")
        parts.append(f"SELECT workspace, chunk_id, text, {k} AS form, unnest(regexp_extract_all(text, '{whole}', 1)) AS whole, unnest(regexp_extract_all(text, '{whole}', 2)) AS part, unnest(range(len(regexp_extract_all(text, '{whole}', 1)))) AS pos FROM texts")
    return "found AS (" + " UNION ALL ".join(parts) + ")"


_TEMPLATE = "texts AS (SELECT 'part' AS workspace, p_partkey AS chunk_id, 'SECTION ' || p_partkey || '. ' || upper(p_name) || chr(10) || '\"' || upper(p_name[1:1]) || p_name[2:] || '\" means the ' || p_type || ' item. See Section ' || (p_partkey % 7) || ' and `' || replace(p_name, ' ', '_') || '`.' AS text, 'SECTION ' || p_partkey || '. ' || upper(p_name) AS name FROM part)"


def _contract(spark: SparkSession, sf: str) -> DataFrame:
    """A contract with one section per part, for the forms that the test texts lack."""
    name, head = F.col("p_name"), F.concat(F.lit("SECTION "), F.col("p_partkey"), F.lit(". "), F.upper("p_name"))
    term = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000))
    text = F.concat(head, F.lit('\n"'), term, F.lit('" means the '), F.col("p_type"), F.lit(" item. See Section "), (F.col("p_partkey") % 7).cast("string"), F.lit(" and `"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("`."))
    return _table(spark, sf, "part").select(F.lit("part").alias("workspace"), F.col("p_partkey").alias("chunk_id"), F.lit(0).alias("artifact_id"), head.alias("name"), text.alias("text"))


_DEFINED = f"""{_matches_sql(P.DEFINITIONS)}, terms AS (
  SELECT workspace, chunk_id, form, pos, trim(regexp_replace(part, '\\s+', ' ', 'g'), ' ,') AS name, replace(substr(text, position(whole IN text), 160), chr(10), ' ') AS definition FROM found)
SELECT workspace, name, count(*) AS mentions, arg_min(definition, struct_pack(c := chunk_id, f := form, p := pos)) AS definition FROM terms WHERE len(name) >= 2 GROUP BY ALL"""


@query(f"WITH {_TEMPLATE}, {_DEFINED}")
def defined_terms_tmpl(spark: SparkSession, sf: str) -> DataFrame:
    return extract.defined_term_entities(_contract(spark, sf))


_DOCS = "texts AS (SELECT coalesce(source, '') AS workspace, doc_id AS chunk_id, regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g') AS text FROM documents WHERE text IS NOT NULL)"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of their source, with accented Latin letters masked so that all regex dialects agree on word boundaries."""
    masked = F.regexp_replace("text", "[ªµºÀ-ÖØ-öø-ɏ]", "_")
    return _table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("workspace"), F.col("doc_id").alias("chunk_id"), F.col("title").alias("name"), masked.alias("text"))


@query(f"WITH {_DOCS}, {_DEFINED}")
def defined_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that the documents of a source define."""
    return extract.defined_term_entities(_documents(spark, sf))


@query(f"""WITH {_DOCS} SELECT DISTINCT chunk_id AS doc_id, upper(unnest(regexp_extract_all(text, '{_q(P.CROSS_REFERENCE)}', 1))) AS number FROM texts""")
def section_references(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of the sections that each document refers to."""
    numbers = F.regexp_extract_all("text", F.lit(P.CROSS_REFERENCE), F.lit(1))
    return _documents(spark, sf).where("text is not null").select(F.col("chunk_id").alias("doc_id"), F.explode(F.array_distinct(F.transform(numbers, lambda n: F.upper(n)))).alias("number"))


@query(f"""WITH {_DOCS}, {_matches_sql([p for g in P.MARKERS.values() for p in g])}, marks AS (
  SELECT workspace, chunk_id, form, pos, trim(regexp_replace(part, '\\s+', ' ', 'g')) AS name, len(substr(text, 1, position(whole IN text) - 1)) - len(replace(substr(text, 1, position(whole IN text) - 1), chr(10), '')) + 1 AS line FROM found)
SELECT workspace, name, count(*) AS mentions, arg_min(line, struct_pack(c := chunk_id, f := form, p := pos)) AS line FROM marks WHERE len(name) BETWEEN 1 AND 90 GROUP BY ALL""")
def structural_markers(spark: SparkSession, sf: str) -> DataFrame:
    return extract.marker_entities(_documents(spark, sf))


_XREF = _q(P.CROSS_REFERENCE)


@query(f"""WITH {_TEMPLATE}, secs AS (SELECT chunk_id AS id, name, regexp_extract(name, '{_XREF}', 1) AS number FROM texts),
num AS (SELECT number, min(id) AS dst_id FROM secs WHERE number <> '' GROUP BY 1),
src AS (SELECT t.name, min(s.id) AS src_id FROM texts t JOIN secs s ON starts_with(t.name, s.name) OR starts_with(s.name, t.name) GROUP BY 1),
refs AS (SELECT DISTINCT workspace, name, unnest(regexp_extract_all(text, '{_XREF}', 1)) AS number FROM texts)
SELECT DISTINCT workspace, src_id, dst_id FROM refs JOIN src USING (name) JOIN num USING (number) WHERE src_id <> dst_id""")
def cross_references_tmpl(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _contract(spark, sf)
    return extract.cross_references(chunks, chunks.select("workspace", F.col("chunk_id").alias("id"), "name"))


@query(f"""WITH {_TEXTS}, s AS (SELECT workspace, chunk_id, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS surface, unnest(range(len(regexp_extract_all(text, '`([^`]+)`', 1)))) AS pos FROM txt),
n AS (SELECT *, string_split(string_split(trim(surface), '(')[1], '.')[-1] AS name FROM s)
SELECT workspace, chunk_id, name, arg_min(surface, pos) AS surface FROM n WHERE regexp_full_match(name, '[A-Za-z_]\\w{{2,}}') GROUP BY ALL""")
def code_spans(spark: SparkSession, sf: str) -> DataFrame:
    return extract.code_spans(_texts(spark, sf))


_HOSTS = "art2 AS (SELECT p_partkey AS artifact_id, CASE p_partkey % 4 WHEN 0 THEN 'x = 1' || chr(10) || '@app.get(\"/' || replace(p_name, ' ', '/') || '/{id}\")' WHEN 1 THEN 'requests.post(\"http://svc.local/' || replace(p_name, ' ', '/') || '/:id?x=1\")' WHEN 2 THEN 'bus.subscribe(\"' || replace(p_name, ' ', '.') || '\")' ELSE 'bus.publish(1, \"' || replace(p_name, ' ', '.') || '\")' END AS text, 'part/' || p_brand AS root FROM part)"


def _services(spark: SparkSession, sf: str) -> DataFrame:
    """A small source file per part that declares or calls a route or topic named by the part."""
    route, topic = F.replace("p_name", F.lit(" "), F.lit("/")), F.replace("p_name", F.lit(" "), F.lit("."))
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('x = 1\n@app.get("/'), route, F.lit('/{id}")'))).when(kind == 1, F.concat(F.lit('requests.post("http://svc.local/'), route, F.lit('/:id?x=1")')))
        .when(kind == 2, F.concat(F.lit('bus.subscribe("'), topic, F.lit('")'))).otherwise(F.concat(F.lit('bus.publish(1, "'), topic, F.lit('")')))
    )
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("artifact_id"), text.alias("text"), F.concat(F.lit("part/"), F.col("p_brand")).alias("root"))


_ENDPOINTS = f"""{_HOSTS}, ep AS (
  SELECT artifact_id, root, CASE WHEN artifact_id % 4 < 2 THEN 'http' ELSE 'topic' END AS kind, CASE WHEN artifact_id % 2 = 0 THEN 'server' ELSE 'client' END AS role,
    CASE WHEN artifact_id % 4 = 0 THEN '/' || replace(p_name, ' ', '/') || '/{{}}' WHEN artifact_id % 4 = 1 THEN '/' || replace(p_name, ' ', '/') || '/{{}}' ELSE lower(replace(p_name, ' ', '.')) END AS key,
    CASE WHEN artifact_id % 4 = 0 THEN '/' || replace(p_name, ' ', '/') || '/{{id}}' WHEN artifact_id % 4 = 1 THEN 'http://svc.local/' || replace(p_name, ' ', '/') || '/:id?x=1' ELSE replace(p_name, ' ', '.') END AS raw,
    CASE WHEN artifact_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS line
  FROM art2 JOIN part ON p_partkey = artifact_id)"""


@query(f"WITH {_ENDPOINTS} SELECT artifact_id, kind, role, key, raw, line FROM ep")
def connectors_tmpl(spark: SparkSession, sf: str) -> DataFrame:
    return extract.connectors(_services(spark, sf).select("artifact_id", "text"))


def _endpoints(spark: SparkSession, sf: str) -> DataFrame:
    places = _services(spark, sf)
    found = extract.connectors(places.select("artifact_id", "text"))
    return found.join(places.select("artifact_id", "root"), "artifact_id").withColumn("workspace", F.lit("part")).withColumn("path", F.concat("root", F.lit("/"), "artifact_id"))


_BOUND = """SELECT DISTINCT c.workspace, c.kind, c.key, c.artifact_id AS client_artifact, c.line AS client_line, s.artifact_id AS server_artifact, s.line AS server_line,
  CASE WHEN c.root <> s.root THEN 1 ELSE 0 END AS cross_repo, CASE WHEN contains(c.key, '{}') THEN 0.55::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM e c JOIN e s ON c.workspace = s.workspace AND c.kind = s.kind AND c.key = s.key AND c.role = 'client' AND s.role = 'server'
JOIN (SELECT workspace, kind, key, count(*) FILTER (role = 'client') AS x, count(*) FILTER (role = 'server') AS y FROM e GROUP BY ALL) g ON g.workspace = c.workspace AND g.kind = c.kind AND g.key = c.key
WHERE x * y <= 40 AND (c.artifact_id IS DISTINCT FROM s.artifact_id OR c.line IS DISTINCT FROM s.line)"""


@query(f"WITH {_ENDPOINTS}, e AS (SELECT *, 'part' AS workspace FROM ep) {_BOUND}")
def bindings_tmpl(spark: SparkSession, sf: str) -> DataFrame:
    return link.bind(_endpoints(spark, sf))


_CONN = f"""conn AS (SELECT id, workspace, {_json('kind')} AS kind, {_json('role')} AS role, {_json('key_norm')} AS key, TRY_CAST({_json('artifact_id')} AS BIGINT) AS artifact_id, TRY_CAST({_json('line')} AS BIGINT) AS line FROM edg WHERE edge_type = 'connector'),
e AS (SELECT conn.workspace, conn.kind, role, key, artifact_id, line, path, array_to_string(string_split(replace(path, chr(92), '/'), '/')[1:4], '/') AS root FROM conn JOIN art ON art.id = artifact_id WHERE key IS NOT NULL)"""


def _stored_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Connector edges of the store, with the folder of their artifact's service as root."""
    edges, artifacts = _tables(spark, sf, "edges", "artifacts")
    arts = read.current_artifacts(artifacts).select(F.col("id").alias("artifact_id"), "path")
    rows = read.typed_connectors(edges).join(arts, "artifact_id")
    return rows.withColumn("root", F.array_join(F.slice(F.split(F.translate("path", "\\", "/"), "/"), 1, 4), "/"))


@query(f"""WITH {_ART}, {_EDG}, {_CONN}, g AS (SELECT workspace, kind, key, count(*) FILTER (role = 'client') AS x, count(*) FILTER (role = 'server') AS y FROM e GROUP BY ALL)
SELECT workspace, role, kind, key, path, line FROM e JOIN g USING (workspace, kind, key) WHERE x = 0 OR y = 0 QUALIFY row_number() OVER (PARTITION BY workspace, kind, key, role ORDER BY artifact_id, line NULLS FIRST, path) = 1""")
def unbound_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return link.unbound(_stored_endpoints(spark, sf))


# ---- linking ----


@query(f"""WITH {_CHU}, base AS (SELECT DISTINCT m.workspace, chunk_id, entity_id AS e FROM mentions m WHERE entity_id IS NOT NULL AND chunk_id IN (SELECT id FROM chu)),
pairs AS (SELECT a.workspace, a.e AS src_id, b.e AS dst_id, count(*) AS shared, min(a.chunk_id) AS c FROM base a JOIN base b ON a.workspace = b.workspace AND a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY ALL HAVING count(*) >= 2)
SELECT pairs.workspace, src_id, dst_id, shared, TRY_CAST(CASE WHEN regexp_full_match(name, 'p[0-9]{{1,9}}') THEN substr(name, 2) END AS INTEGER) AS first_page, round(least(1.0::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * shared), 6) AS confidence FROM pairs JOIN chu ON chu.id = c""")
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return link.cooccurrence(*_tables(spark, sf, "mentions", "chunks")).withColumn("confidence", F.round("confidence", 6))


_GROUND = f"""{_ART}, {_CHU}, {_ENT}, gr AS (
  SELECT DISTINCT e.workspace, e.id AS entity_id, e.name, e.etype, c.id AS chunk_id, a.kind FROM ent e JOIN mentions m ON m.entity_id = e.id JOIN chu c ON c.id = m.chunk_id JOIN art a ON a.id = c.artifact_id)"""
_KEY = "lower(regexp_replace(name, '[_\\s-]+', '', 'g'))"


@query(f"""WITH {_GROUND}, code AS (SELECT *, {_KEY} AS key FROM gr WHERE kind = 'code' AND etype = 'symbol'),
x AS (SELECT workspace, name, min(struct_pack(e := entity_id, c := chunk_id, n := name)) AS m FROM code GROUP BY ALL), f AS (SELECT workspace, key, min(struct_pack(e := entity_id, c := chunk_id, n := name)) AS m FROM code GROUP BY ALL),
docs AS (SELECT workspace, entity_id, name, min(chunk_id) AS doc_chunk, {_KEY} AS key FROM gr WHERE kind IN ('docs', 'pdf') GROUP BY ALL)
SELECT d.workspace, d.entity_id AS src_id, (coalesce(x.m, f.m)).e AS dst_id, CASE WHEN x.m IS NOT NULL THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN x.m IS NOT NULL THEN 'exact' ELSE 'fuzzy' END AS method,
  d.name, (coalesce(x.m, f.m)).n AS code_symbol, doc_chunk, (coalesce(x.m, f.m)).c AS code_chunk
FROM docs d LEFT JOIN x ON x.workspace = d.workspace AND x.name = d.name LEFT JOIN f ON f.workspace = d.workspace AND f.key = d.key AND len(d.key) >= 4 WHERE x.m IS NOT NULL OR f.m IS NOT NULL""")
def doc_code_links(spark: SparkSession, sf: str) -> DataFrame:
    tables = _tables(spark, sf, "entities", "mentions", "chunks", "artifacts")
    code = link.grounded(*tables, ("code",)).where("etype = 'symbol'")
    return link.doc_code_links(link.grounded(*tables, ("docs", "pdf")), code)


@query(f"""WITH {_ART}, roots AS (SELECT DISTINCT workspace, '/srv/' || workspace AS r FROM art UNION SELECT DISTINCT workspace, array_to_string(string_split(replace(path, chr(92), '/'), '/')[1:4], '/') FROM art),
p AS (SELECT id, workspace, replace(path, chr(92), '/') AS path FROM art)
SELECT id, workspace, path, (SELECT max_by(r, len(r)) FROM roots WHERE roots.workspace = p.workspace AND (p.path = r OR starts_with(p.path, r || '/'))) AS root FROM p""")
def artifact_roots(spark: SparkSession, sf: str) -> DataFrame:
    arts = read.current_artifacts(_table(spark, sf, "artifacts")).select("id", "workspace", F.translate("path", "\\", "/").alias("path"))
    own = arts.select("workspace", F.array_join(F.slice(F.split("path", "/"), 1, 4), "/").alias("root_path"))
    roots = arts.select("workspace", F.concat(F.lit("/srv/"), "workspace").alias("root_path")).unionByName(own).distinct()
    return link.root_of(arts, roots).select("id", "workspace", "path", "root")


@query(f"""WITH {_CHU}, s AS (SELECT DISTINCT artifact_id AS owner, name, start_line::BIGINT AS lo, end_line::BIGINT AS hi FROM chu WHERE start_line <= end_line),
p AS (SELECT DISTINCT artifact_id AS owner, (start_line + 3)::BIGINT AS pt FROM chu WHERE start_line IS NOT NULL),
b AS (SELECT p.owner, p.pt, min(struct_pack(w := hi - lo, l := lo, n := name)) AS m FROM p JOIN s ON s.owner = p.owner AND p.pt BETWEEN s.lo AND s.hi GROUP BY ALL)
SELECT p.owner, p.pt AS "at", m.n AS name FROM p LEFT JOIN b ON b.owner = p.owner AND b.pt = p.pt""")
def enclosing_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The narrowest chunk around the fourth line of each chunk that has lines."""
    chunks = _table(spark, sf, "chunks").where("start_line is not null").select(F.col("artifact_id").alias("owner"), "name", F.col("start_line").cast("long").alias("lo"), F.col("end_line").cast("long").alias("hi"))
    return link.narrowest(chunks.select("owner", (F.col("lo") + 3).alias("at")).distinct(), chunks.distinct()).select("owner", "at", "name")


# ---- resolution ----

_ALIAS = f"""{_ENT}, cnt AS (SELECT entity_id AS id, count(*) AS n FROM mentions GROUP BY 1),
keyed AS (SELECT e.workspace, e.id, e.name, e.etype, coalesce(n, 0) AS n, trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(e.name), '^(?i:the|a|an)\\s+', ''), '[^\\w\\sªµºÀ-ÖØ-öø-ɏ]', '', 'g')), '\\s+', ' ', 'g')) AS key FROM ent e LEFT JOIN cnt USING (id)),
buckets AS (SELECT workspace, coalesce(etype, '') AS t, key, count(*) AS bucket_size, (max(struct_pack(n := n, l := len(name), i := -id, id := id))).id AS canonical_id FROM keyed WHERE key <> '' GROUP BY ALL HAVING count(*) > 1),
al AS (SELECT k.workspace, k.etype, k.key, k.id, k.name, canonical_id, bucket_size FROM keyed k JOIN buckets b ON b.workspace = k.workspace AND b.t = coalesce(k.etype, '') AND b.key = k.key)"""


@query(f"WITH {_ALIAS} SELECT * FROM al")
def alias_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.alias_buckets(*_tables(spark, sf, "entities", "mentions"))


def _merges(spark: SparkSession, sf: str) -> DataFrame:
    return durable(alias_buckets(spark, sf).where("id <> canonical_id").select(F.col("id").alias("old_id"), F.col("canonical_id").alias("new_id")), "merges")


@query(f"WITH {_ALIAS}, m AS (SELECT id AS o, canonical_id AS n FROM al WHERE id <> canonical_id), {_EDG} SELECT edg.id, coalesce(x.n, src_id) AS src_id, coalesce(y.n, dst_id) AS dst_id, edge_type FROM edg LEFT JOIN m x ON x.o = src_id LEFT JOIN m y ON y.o = dst_id")
def merged_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = _table(spark, sf, "edges").distinct().select("id", "src_id", "dst_id", "edge_type")
    merges = _merges(spark, sf)
    return resolve.repoint(resolve.repoint(edges, merges, "src_id"), merges, "dst_id")


@query(f"WITH {_ALIAS} SELECT canonical_id AS id, any_value(name) FILTER (id = canonical_id) AS name, array_to_string(list_sort(list_distinct(list(name) FILTER (id <> canonical_id))), '|') AS aliases FROM al GROUP BY canonical_id")
def merged_aliases(spark: SparkSession, sf: str) -> DataFrame:
    entities = _table(spark, sf, "entities").select("id", "name", F.lit(None).cast("array<string>").alias("aliases")).dropDuplicates(["id"])
    return resolve.fuse_aliases(entities, _merges(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


_COS = "list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-9) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-9))"
_VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_NEAR = f"near AS (SELECT a.id AS a, b.id AS b, round({_COS}, 6) AS similarity FROM vec a JOIN vec b ON a.id < b.id WHERE {_COS} >= 0.4)"


def _near(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.lit("all").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return resolve.similar_pairs(vectors, 0.4)


@query(f"WITH {_VEC}, {_NEAR} SELECT a, b, similarity FROM near")
def similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH RECURSIVE {_VEC}, {_NEAR}, ends AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(id, r) AS (SELECT a, a FROM ends UNION SELECT ends.b, reach.r FROM reach JOIN ends ON ends.a = reach.id WHERE reach.r < ends.b) SELECT id, min(r) AS group_id FROM reach GROUP BY id")
def vector_groups(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.linked_groups(durable(_near(spark, sf), "near"))


# ---- search ----

@query("""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), lambda w: w <> '') AS w FROM documents), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d),
q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+')) AS term FROM eval_items) WHERE term <> ''),
tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each test item."""
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    items = _table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "text").distinct()
    return search.bm25(docs, items).withColumn("score", F.round("score", 6))


@query("""WITH docs AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM docs),
q AS (SELECT DISTINCT p_brand AS query_id, lower(unnest(string_split(p_type, ' '))) AS term FROM (SELECT p_brand, min(p_type) AS p_type FROM part GROUP BY 1)),
tf AS (SELECT id, len(w) AS l, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM docs) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def bm25_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = _table(spark, sf, "part")
    queries = part.groupBy(F.col("p_brand").alias("query_id")).agg(F.min("p_type").alias("text"))
    return search.bm25(part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), queries).withColumn("score", F.round("score", 6))


_RANKED = f"{_VEC}, q AS (SELECT id, v FROM vec WHERE id % 20 = 0), r AS (SELECT a.id AS query_id, b.id, round({_COS}, 9) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS}, 9) DESC, b.id) AS rank FROM q a, vec b QUALIFY rank <= 10)"


def _vector_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors, vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", "label")


@query(f"WITH {_RANKED} SELECT query_id, id, round(score, 6) AS score, rank FROM r")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _vector_queries(spark, sf)
    return search.vector_ranking(vectors, queries).withColumn("score", F.round("score", 6))


@query(f"""WITH {_RANKED}, l AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(q.label - e.label), e.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e QUALIFY rank <= 10),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM (SELECT query_id, id, rank FROM r UNION ALL SELECT query_id, id, rank FROM l) GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors and nearest labels, fused."""
    vectors, queries = _vector_queries(spark, sf)
    near = vectors.select("id", "label").crossJoin(F.broadcast(queries.select("query_id", F.col("label").alias("l"))))
    by_label = resolve.keep_top(near, ["query_id"], [F.abs(F.col("label") - F.col("l")), F.col("id")], 10)
    return search.fuse_rankings([search.vector_ranking(vectors, queries), by_label]).withColumn("score", F.round("score", 6))


# ---- sources, scalar functions, rendering ----


@query(f"""WITH {_ART}, p AS (SELECT id, lower(regexp_extract(string_split(replace(path, chr(92), '/'), '/')[-1], '.(\\.[^.]*)$', 1)) AS s FROM art)
SELECT CASE WHEN s = '' THEN '(none)' ELSE s END AS extension, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, extension LIMIT 15""")
def extension_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return files.extension_counts(read.current_artifacts(_table(spark, sf, "artifacts")).select("path"))


@query(f"""WITH {_ART}, p AS (SELECT id, string_split(replace(path, chr(92), '/'), '/')[-1] AS base, lower(regexp_extract(string_split(replace(path, chr(92), '/'), '/')[-1], '.(\\.[^.]*)$', 1)) AS s FROM art)
SELECT id, base, s AS suffix, CASE WHEN s IN ('.py', '.ts', '.tsx', '.js', '.jsx', '.rs', '.go', '.java', '.rb') THEN 'code' ELSE 'docs' END AS kind FROM p""")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return read.current_artifacts(_table(spark, sf, "artifacts")).select("id", base_name(p).alias("base"), suffix(p).alias("suffix"), files.kind_by_extension(p).alias("kind"))


_SLUG = "regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS sha, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines,
  CASE WHEN {_SLUG} = '' THEN 'artifact' ELSE substr({_SLUG}, 1, 60) END AS slug, trim(translate(coalesce(title, ''), '"`' || chr(10), ''''' ')) AS label FROM documents""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    text, title = F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))
    return _table(spark, sf, "documents").select("doc_id", T.sha16(text).alias("sha"), T.line_at(text, F.length(text) + 1).alias("lines"), T.slug(title).alias("slug"), T.safe_label(title).alias("label"))


@query(f"""WITH {_ENT} SELECT id, lower(regexp_replace(name, '[_\\s-]+', '', 'g')) AS symbol_key,
  trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(name), '^(?i:the|a|an)\\s+', ''), '[^\\w\\sªµºÀ-ÖØ-öø-ɏ]', '', 'g')), '\\s+', ' ', 'g')) AS entity_key FROM ent""")
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return _table(spark, sf, "entities").select("id", "name").distinct().select("id", T.symbol_key(name).alias("symbol_key"), T.entity_key(name).alias("entity_key"))


@query("""WITH t AS (SELECT doc_id AS artifact_id, regexp_split_to_array(text, '\n') AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT artifact_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM t),
h AS (SELECT *, regexp_matches(line, '^[ \\t]*(#{1,6}[ \\t]+\\S.*|(SECTION|Section|ARTICLE|Article|CHAPTER|Chapter)[ \\t]+[\\w.\\-]+.*|(INT\\.|EXT\\.|INT/EXT\\.?)[ \\t].*)[ \\t]*$') AS head FROM r),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY artifact_id ORDER BY i) AS part FROM h),
c AS (SELECT artifact_id, part, string_agg(line, chr(10) ORDER BY i) AS body, first(line ORDER BY i) AS top, bool_or(head) AS named, max(part) OVER (PARTITION BY artifact_id) AS parts FROM g GROUP BY artifact_id, part)
SELECT artifact_id, CASE WHEN named THEN trim(ltrim(trim(top), '#')) ELSE 'doc-' || artifact_id || '.md' END AS name, len(replace(body, chr(10), '')) AS n_chars FROM c WHERE named OR parts = 0 OR regexp_matches(body, '\\S')""")
def doc_divisions(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("artifact_id"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("path"), "text")
    return files.doc_chunks(docs).select("artifact_id", "name", F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("long").alias("n_chars"))


#: In SQL a specification is one whose lines all look like those of the documents' dialect; what else a parser takes does not occur.
_SPECS = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(substr(text, 1, 4096), '""" + _q(P.SPEC_SNIFF) + """')),
ok AS (SELECT * FROM d WHERE len(list_filter(l, lambda x: NOT regexp_full_match(x, '\\s*(?:[\\w{}/.$''-]+:(?: .*)?|- .*)?'))) = 0),
r AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM ok), title AS (SELECT doc_id, any_value(trim(substr(line, 10))) AS title FROM r WHERE line LIKE '  title: %' GROUP BY 1),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^  /\\S+:$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
p AS (SELECT doc_id, k, any_value(substr(line, 3, len(line) - 3)) FILTER (regexp_matches(line, '^  /\\S+:$')) AS route,
  string_agg(upper(trim(line, ' :')), ' ' ORDER BY i) FILTER (regexp_matches(line, '^    (get|put|post|delete|patch|head|options|trace):$')) AS methods,
  string_agg(CASE WHEN line LIKE '      summary: %' THEN ': ' || trim(substr(line, 16)) ELSE chr(10) || upper(trim(line, ' :')) END, '' ORDER BY i) FILTER (line LIKE '      summary: %' OR regexp_matches(line, '^    [a-z]+:$')) AS said
  FROM m WHERE k > 0 GROUP BY 1, 2),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, route ORDER BY k DESC) = 1), o AS (SELECT doc_id, route, row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) - 1 AS ord FROM p GROUP BY 1, 2)
SELECT u.doc_id AS artifact_id, ord, methods || ' ' || route AS name, (SELECT min(i) FROM r WHERE r.doc_id = u.doc_id AND contains(line, route))::INTEGER AS start_line, route, title || ' ' || methods || ' ' || route || said AS text
FROM u JOIN o USING (doc_id, route) JOIN title ON title.doc_id = u.doc_id"""


@query(_SPECS)
def spec_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints that the OpenAPI documents declare."""
    specs = _table(spark, sf, "documents").where(F.regexp_like(F.substring("text", 1, 4096), F.lit(P.SPEC_SNIFF))).select(F.col("doc_id").alias("artifact_id"), F.concat(F.lit("spec-"), F.col("doc_id"), F.lit(".yaml")).alias("path"), "text")
    return files.spec_chunks(specs).select("artifact_id", "ord", "name", "start_line", "route", "text")


@query()
def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Calls in the code notes, parsed as Python."""
    code = _table(spark, sf, "documents").where("lower(trim(source)) like 'code%notes'").select(F.col("doc_id").alias("artifact_id"), F.lit("python").alias("lang"), "text")
    return files.call_pairs(code).groupBy("artifact_id", "enclosing", "callee").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ENT} SELECT id, workspace, name, etype FROM ent")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Entities through JSON and back."""
    rows = _table(spark, sf, "entities").select("id", "workspace", "name", "etype").distinct()
    return render.to_json(rows).select(F.from_json("value", "id long, workspace string, name string, etype string").alias("r")).select("r.*")


# ---- writing ----


def _graph(spark: SparkSession, sf: str, *names: str) -> Graph:
    return Graph(spark).with_tables(**{n: _table(spark, sf, n).distinct() for n in names})


_LATE = "late AS (SELECT workspace, name, etype, props, (min(struct_pack(a := arrived_at, i := id))).i AS id FROM (SELECT l.*, max(struct_pack(a := arrived_at, i := -id)) OVER (PARTITION BY workspace, name, etype) AS last FROM (SELECT DISTINCT * FROM late_entities) l) WHERE struct_pack(a := arrived_at, i := -id) = last GROUP BY ALL)"


@query(f"""WITH {_ENT}, {_LATE}, old AS (SELECT workspace, name, etype, min(id) AS id FROM ent GROUP BY ALL)
SELECT id, workspace, name, etype FROM ent WHERE NOT EXISTS (SELECT 1 FROM late l WHERE l.workspace IS NOT DISTINCT FROM ent.workspace AND l.name IS NOT DISTINCT FROM ent.name AND l.etype IS NOT DISTINCT FROM ent.etype)
UNION ALL SELECT coalesce(o.id, l.id), l.workspace, l.name, l.etype FROM late l LEFT JOIN old o ON l.workspace IS NOT DISTINCT FROM o.workspace AND l.name IS NOT DISTINCT FROM o.name AND l.etype IS NOT DISTINCT FROM o.etype""")
def upserted_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with the late ones upserted by workspace, name and type; known ones keep their id."""
    entities, late = _tables(spark, sf, "entities", "late_entities")
    out = write.upsert(entities.distinct(), late.distinct(), ["workspace", "name", "etype"], keep=["id"], order=[F.col("arrived_at"), -F.col("id")])
    return out.select("id", "workspace", "name", "etype")


@query("""WITH names AS (SELECT DISTINCT workspace AS name FROM artifacts UNION SELECT DISTINCT 'new-' || workspace FROM chunks)
SELECT DISTINCT name FROM workspaces UNION SELECT name FROM names""")
def inserted_workspaces(spark: SparkSession, sf: str) -> DataFrame:
    """Workspaces with those added that artifacts and chunks name and that are not there yet."""
    have = _table(spark, sf, "workspaces").select("name").distinct()
    more = _table(spark, sf, "artifacts").select(F.col("workspace").alias("name")).unionByName(_table(spark, sf, "chunks").select(F.concat(F.lit("new-"), "workspace").alias("name")))
    return write.insert_new(have, more, ["name"])


@query(f"""WITH {_ENT}, {_EDG}, gone AS (SELECT id FROM ent WHERE {_json('origin')} = 'salient')
SELECT id, src_id, dst_id, edge_type FROM edg WHERE coalesce(src_id NOT IN (SELECT id FROM gone), true) AND coalesce(dst_id NOT IN (SELECT id FROM gone), true)""")
def cleared_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that stay when all entities of one origin go."""
    graph = _graph(spark, sf, "entities", "mentions", "edges")
    ids = graph["entities"].where(T.json_text(F.col("props"), "$.origin") == "salient").select("id")
    return write.remove_entities(graph, ids)["edges"].select("id", "src_id", "dst_id", "edge_type")


@query(f"""WITH {_ENT}, p AS (SELECT *, coalesce({_json('provisional')} IN ('true', '1'), false) AS prov FROM ent),
types AS (SELECT DISTINCT workspace, name, CASE WHEN len(name) % 3 = 0 THEN 'drop' ELSE 'checked' END AS t FROM p WHERE prov AND name IS NOT NULL),
typed AS (SELECT p.id, p.workspace, p.name, p.etype, CASE WHEN prov THEN t END AS t FROM p LEFT JOIN types USING (workspace, name)),
out AS (SELECT id, workspace, name, coalesce(t, etype) AS etype, t IS NOT NULL AS done FROM typed WHERE t IS NULL OR t <> 'drop')
SELECT id, workspace, name, etype FROM out QUALIFY NOT done OR row_number() OVER (PARTITION BY workspace, name, etype ORDER BY done, id) = 1""")
def classified_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Provisional entities typed or dropped, those of equal names folded."""
    graph = _graph(spark, sf, "entities", "mentions", "edges")
    types = graph["entities"].where(read.is_provisional(F.col("props")) & F.col("name").isNotNull()).select("workspace", "name", F.when(F.length("name") % 3 == 0, "drop").otherwise("checked").alias("type")).distinct()
    return write.classify(graph, types)["entities"].select("id", "workspace", "name", "etype")


_BEST = f"best AS (SELECT workspace, name, (max(struct_pack(c := coalesce(TRY_CAST({_json('count')} AS DOUBLE), 0), i := -id, id := id))).id AS id FROM ent WHERE name IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_ENT}, {_EDG}, {_BEST} SELECT edg.workspace, x.id AS src_id, y.id AS dst_id, 'related' AS edge_type, 0.8::DOUBLE AS confidence, 0 AS asserted
FROM edg JOIN ent s ON s.id = src_id JOIN ent d ON d.id = dst_id JOIN best x ON x.workspace = edg.workspace AND x.name = s.name JOIN best y ON y.workspace = edg.workspace AND y.name = d.name WHERE edg.edge_type = 'references'""")
def claimed_relations(spark: SparkSession, sf: str) -> DataFrame:
    """References told again by the names of their ends, as claims that are not asserted."""
    graph = _graph(spark, sf, "entities", "edges")
    ent = graph["entities"].select("id", "name")
    rows = graph["edges"].where("edge_type = 'references'").join(ent.toDF("src_id", "src"), "src_id").join(ent.toDF("dst_id", "dst"), "dst_id")
    rows = rows.select("workspace", "src", "dst", F.lit("related").alias("relation"), F.lit(None).cast("string").alias("props"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("asserted"))
    made, _ = write.add_relations(graph, rows)
    return made["edges"].where("edge_type = 'related'").select("workspace", "src_id", "dst_id", "edge_type", "confidence", "asserted")


@query(f"""WITH {_ART}, w AS (SELECT workspace, replace(path, chr(92), '/') AS path, id, lens FROM art)
SELECT id, CASE WHEN starts_with(path, '/srv/' || workspace || '/a-service/') AND workspace = (SELECT min(name) FROM workspaces) THEN 'code' ELSE lens END AS lens,
  CASE WHEN starts_with(path, '/srv/' || workspace || '/a-service/') AND workspace = (SELECT min(name) FROM workspaces) THEN 'primary' END AS provenance FROM w""")
def stamped_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    first = _table(spark, sf, "workspaces").agg(F.min("name")).first()[0]
    arts = read.current_artifacts(_table(spark, sf, "artifacts")).withColumn("path", F.translate("path", "\\", "/"))
    return write.stamp(arts, first, f"/srv/{first}/a-service", "code", "primary").select("id", "lens", T.json_text(F.col("props"), "$.provenance").alias("provenance"))


@query(f"""WITH {_ART}, {_CHU} SELECT c.id, CASE WHEN c.kind = 'page' THEN a.path ELSE '/other/' || c.id || '.md' END AS path, CASE WHEN c.kind = 'page' THEN TRY_CAST(substr(c.name, 2) AS INTEGER) END AS page FROM chu c JOIN art a ON a.id = c.artifact_id""")
def derived_places(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as files derived from their artifacts; pages are cited by the original path and page."""
    rows = read.located(*_tables(spark, sf, "chunks", "artifacts"))
    derived = rows.where("kind = 'page'").select(F.concat(F.lit("/derived/"), "id", F.lit(".md")).alias("derived_path"), F.col("path").alias("orig_path"), T.page_of(F.col("name")).alias("page"))
    hits = rows.select("id", F.concat(F.when(F.col("kind") == "page", F.lit("/derived/")).otherwise(F.lit("/other/")), "id", F.lit(".md")).alias("path"))
    return read.original_place(hits, derived).select("id", "path", "page")


@query(f"""WITH {_ART}, s AS (SELECT id, lower(regexp_extract(string_split(replace(path, chr(92), '/'), '/')[-1], '.(\\.[^.]*)$', 1)) AS x FROM art)
SELECT id, CASE WHEN x IN ('.py', '.ts', '.tsx', '.js', '.jsx', '.rs', '.go', '.java', '.rb') THEN 'code' WHEN x IN ('.json', '.yaml', '.yml') THEN 'spec' WHEN x IN ('.md', '.markdown', '.rst', '.txt') THEN 'docs' WHEN x = '.pdf' THEN 'pdf' END AS kind FROM s""")
def source_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Which kind of source takes each artifact's file, if its text began like a specification."""
    arts = read.current_artifacts(_table(spark, sf, "artifacts"))
    return arts.select("id", files.kind_of_path(F.col("path"), F.lit("openapi: 3.0.0")).alias("kind"))


# ---- streams ----


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts, computed as a stream."""
    return events.drain(events.window_counts(events.read_stream(spark, sf, "events")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(rows)
