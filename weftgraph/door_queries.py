"""Queries of ingest, the write door, lenses and rendering over the test tables, each with the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import graph_queries as G
from weftgraph import patterns as P
from weftgraph.functions import text as T
from weftgraph.functions.paths import base_name
from weftgraph.graph_queries import _ART, _CHU, _EDG, _ENT, _graph, _json, _q, _table, _tables, query
from weftgraph.operators import link, read, render, resolve, search, write
from weftgraph.plans import compose, lens
from weftgraph.plans.durable import durable, new_path
from weftgraph.sources import files
from weftgraph.sources.store import Graph

# ---- ingest of a folder: every document as a file ----

_SNIFF = _q(P.SPEC_SNIFF)
_FILES = f"""files AS (SELECT doc_id, coalesce(text, '') AS text, 'doc-' || doc_id || CASE
  WHEN lower(trim(source)) LIKE 'code%notes' THEN CASE WHEN doc_id % 4 = 0 THEN '.rb' ELSE '.py' END WHEN regexp_matches(substr(text, 1, 4096), '{_SNIFF}') THEN '.yaml' WHEN doc_id % 50 = 1 THEN '.bin' ELSE '.md' END AS name FROM documents),
arts AS (SELECT *, CASE WHEN name LIKE '%.rb' OR name LIKE '%.py' THEN 'code' WHEN name LIKE '%.yaml' THEN 'spec' WHEN name LIKE '%.md' THEN 'docs' END AS kind FROM files)"""


def _write_files(spark: SparkSession, sf: str) -> str:
    """Each document as a file of the shared folder, its suffix by what it holds; code notes turn by turn as Python and Ruby."""
    code = F.lower(F.trim("source")).like("code%notes")
    ending = (
        F.when(code, F.when(F.col("doc_id") % 4 == 0, ".rb").otherwise(".py")).when(F.regexp_like(F.substring("text", 1, 4096), F.lit(P.SPEC_SNIFF)), ".yaml")
        .when(F.col("doc_id") % 50 == 1, ".bin").otherwise(".md")
    )
    folder = new_path(spark, "corpus").removeprefix("file://")
    rows = _table(spark, sf, "documents").select(F.concat(F.lit(f"{folder}/_part"), F.col("doc_id") % 97, F.lit("/doc-"), F.col("doc_id"), ending).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch.path, batch.text):
                system, inner, _ = files.open_place(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(text.encode("utf-8", "surrogatepass"))
            yield batch[["path"]]

    durable(rows.mapInPandas(put, "path string"), "written")
    return folder


_INGESTED: dict[tuple[str, str], tuple[Graph, dict, str]] = {}


def _ingested(spark: SparkSession, sf: str) -> tuple[Graph, dict, str]:
    """The graph of the documents' files, ingested once in an application, with the counts and the folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INGESTED:
        folder = _write_files(spark, sf)
        _INGESTED[key] = (*compose.ingest(Graph(spark), folder, "docs", lens="code"), folder)
    return _INGESTED[key]


@query(f"WITH {_FILES} SELECT name, kind, CASE WHEN name LIKE '%.py' THEN 'python' WHEN name LIKE '%.rb' THEN 'ruby' WHEN kind = 'spec' THEN 'openapi' END AS lang, substr(sha256(text), 1, 16) AS sha, 'code' AS lens, 'primary' AS provenance FROM arts WHERE kind IS NOT NULL")
def ingested_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as files and ingested: the artifacts."""
    _INGESTED.pop((spark.sparkContext.applicationId, sf), None)
    arts = _ingested(spark, sf)[0]["artifacts"]
    return arts.select(base_name(F.col("path")).alias("name"), "kind", "lang", "sha", "lens", T.json_text(F.col("props"), "$.provenance").alias("provenance"))


@query(f"WITH {_FILES} SELECT coalesce(kind, 'skipped') AS kind, count(*) AS n FROM arts GROUP BY 1 UNION ALL SELECT 'pdf', 0")
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = _ingested(spark, sf)[1]
    return spark.createDataFrame([(k, counts[k]) for k in ("code", "spec", "docs", "pdf", "skipped")], "kind string, n long")


@query(f"WITH {_FILES} SELECT name, 'file' AS kind, 1 AS start_line, (len(text) - len(replace(text, chr(10), '')) + 1)::INTEGER AS end_line, text FROM arts WHERE name LIKE '%.rb'")
def ingested_plain_code(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of source files in a language without a parser."""
    graph = _ingested(spark, sf)[0]
    ruby = graph["artifacts"].where("lang = 'ruby'").select(F.col("id").alias("artifact_id"))
    return graph["chunks"].join(ruby, "artifact_id").select("name", "kind", "start_line", "end_line", "text")


@query(f"""WITH {_FILES}, s AS (SELECT DISTINCT name AS file, unnest(regexp_extract_all(text, '{_q(P.PLAIN_DEFINITION)}', 1)) AS name FROM arts WHERE name LIKE '%.rb') SELECT file, name FROM s""")
def ingested_plain_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of source files in a language without a parser, by their mentions in the file's chunk."""
    graph = _ingested(spark, sf)[0]
    chunks = graph["chunks"].where("kind = 'file'").select(F.col("id").alias("chunk_id"), F.col("name").alias("file"))
    names = graph["entities"].where("etype = 'symbol'").select(F.col("id").alias("entity_id"), "name")
    return graph["mentions"].join(chunks, "chunk_id").join(names, "entity_id").select("file", "name")


@query(f"WITH {_FILES}, n AS (SELECT count(*) AS files FROM arts), e AS (SELECT string_agg(x || '=' || c, ',' ORDER BY c DESC, x) AS suffixes FROM (SELECT regexp_extract(name, '\\.[a-z]+$') AS x, count(*) AS c FROM arts GROUP BY 1)) SELECT 'directory' AS kind, least(files, 5000)::BIGINT AS file_count, CASE WHEN files <= 5000 THEN suffixes END AS suffixes FROM n, e")
def inspected_folder(spark: SparkSession, sf: str) -> DataFrame:
    """What inspecting the documents' folder says; suffixes only where it has no more files than are counted."""
    said = files.inspect(_ingested(spark, sf)[2])
    suffixes = ",".join(f"{x}={n}" for x, n in said["extensions"].items()) if said["file_count"] < files.INSPECTED else None
    return spark.createDataFrame([(said["kind"], said["file_count"], suffixes)], "kind string, file_count long, suffixes string")


# ---- pages ----

_CUT = 700


@query(f"""WITH d AS (SELECT doc_id, text, greatest(1, ceil(len(text) / {_CUT}.0))::INTEGER AS pages FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'p' || page AS name, page::INTEGER AS page, substr(text, (page - 1) * {_CUT} + 1, {_CUT}) AS text FROM (SELECT *, unnest(range(1, pages + 1)) AS page FROM d)""")
def derived_page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in pages of 700 characters: the page chunks, read back from the files derived from them."""
    rows = _table(spark, sf, "documents").where("text is not null")
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / _CUT)).cast("int") - 1), lambda k: F.substring(F.col("text"), k * _CUT + 1, F.lit(_CUT)))
    cut = rows.select(F.concat(F.lit("/books/"), "doc_id", F.lit(".pdf")).alias("path"), F.posexplode(pages).alias("k", "text")).select("path", (F.col("k") + 1).alias("page"), "text")
    derived = durable(files.derived_pages(cut, new_path(spark, "derived").removeprefix("file://")), "derived")
    back = files.read_texts(derived.select(F.col("derived_path").alias("path")))
    placed = read.original_place(back, derived)
    return placed.select(F.regexp_extract("path", r"(\d+)\.pdf\z", 1).cast("long").alias("doc_id"), F.concat(F.lit("p"), "page").alias("name"), "page", "text")


# ---- calls ----

_CALLS = f"""calls AS (SELECT DISTINCT m.workspace, c.artifact_id, c.name AS enclosing, m.surface AS callee, m.id AS site FROM mentions m JOIN chu c ON c.id = m.chunk_id WHERE c.kind IN ('function', 'method', 'class', 'struct') AND m.surface IS NOT NULL AND c.name IS NOT NULL AND c.name <> m.surface),
sym AS (SELECT workspace, name, min(id) AS id FROM ent WHERE etype = 'symbol' AND name IS NOT NULL GROUP BY ALL), inside AS (SELECT calls.*, sym.id AS src_id FROM calls JOIN sym ON sym.workspace = calls.workspace AND sym.name = enclosing)"""


def _calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mentions in definitions read as calls, the symbols, and the chunks."""
    chunks, mentions, entities = _tables(spark, sf, "chunks", "mentions", "entities")
    places = chunks.where("kind in ('function', 'method', 'class', 'struct') and name is not null").select(F.col("id").alias("chunk_id"), "artifact_id", F.col("name").alias("enclosing")).distinct()
    calls = mentions.select("id", "workspace", "chunk_id", F.col("surface").alias("callee")).distinct().where("callee is not null").join(places, "chunk_id").where("enclosing <> callee").select("workspace", "artifact_id", "enclosing", "callee")
    return calls, entities.where("etype = 'symbol'").select("workspace", "id", "name").distinct(), chunks


@query(f"""WITH {_CHU}, {_ENT}, {_CALLS} SELECT inside.workspace, src_id, callee, count(*) AS sites, max(sym.id) AS known_id FROM inside LEFT JOIN sym ON sym.workspace = inside.workspace AND sym.name = callee GROUP BY ALL""")
def call_links(spark: SparkSession, sf: str) -> DataFrame:
    """Calls resolved by name in the workspace, with their number; known_id is null for callees that had to be added."""
    calls, symbols, _ = _calls(spark, sf)
    edges, new = link.call_edges(durable(calls, "calls"), symbols)
    known = symbols.groupBy("workspace", "name").agg(F.min("id").alias("id"))
    names = known.select("id", F.col("name").alias("callee"), F.col("id").alias("known_id")).unionByName(new.select("id", F.col("name").alias("callee"), F.lit(None).cast("long").alias("known_id")))
    return edges.join(names.withColumnRenamed("id", "dst_id"), "dst_id").groupBy("workspace", "src_id", "callee").agg(F.count(F.lit(1)).alias("sites"), F.max("known_id").alias("known_id"))


@query(f"""WITH {_CHU}, {_ENT}, {_CALLS}, first AS (SELECT workspace, artifact_id, name, arg_min(id, struct_pack(s := coalesce(start_line, -1), e := -coalesce(end_line, 1000000000), i := id)) AS chunk_id FROM chu WHERE name IS NOT NULL GROUP BY ALL)
SELECT inside.workspace, chunk_id, sym.id AS entity_id, callee AS surface, count(*) AS sites FROM inside JOIN first f ON f.workspace = inside.workspace AND f.artifact_id = inside.artifact_id AND f.name = enclosing JOIN sym ON sym.workspace = inside.workspace AND sym.name = callee GROUP BY ALL""")
def callee_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Where callees are mentioned: in the first chunk of the definition that calls them."""
    calls, symbols, chunks = _calls(spark, sf)
    said = link.call_mentions(durable(calls, "calls"), symbols, chunks)
    return said.groupBy("workspace", "chunk_id", "entity_id", "surface").agg(F.count(F.lit(1)).alias("sites"))


# ---- reading ----


@query(f"""WITH {_ENT}, {_EDG}, busy AS (SELECT s.name FROM edg JOIN ent s ON s.id = src_id WHERE cross_source = 1 AND confidence IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s.name LIMIT 1)
SELECT e.workspace, e.id, e.edge_type, e.confidence, e.method, e.asserted, s.name AS src, s.etype AS src_type, d.name AS dst, d.etype AS dst_type FROM edg e JOIN ent s ON s.id = e.src_id JOIN ent d ON d.id = e.dst_id
WHERE e.cross_source = 1 AND e.confidence >= 0 AND (s.name = (SELECT name FROM busy) OR d.name = (SELECT name FROM busy))""")
def cross_edges_named(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-source edges at the name that is most often their source."""
    edges, entities = _tables(spark, sf, "edges", "entities")
    busy = edges.where("cross_source = 1 and confidence is not null").distinct().select(F.col("src_id").alias("id")).join(entities.select("id", "name", "etype", "workspace", "props").distinct(), "id").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").first()
    return read.cross_edges(edges, entities, busy.name if busy else "")


@query(f"""WITH {G._VEC}, q AS (SELECT id, v FROM vec WHERE id % 20 = 0), h AS (SELECT q.id AS query_id, e.label AS root, b.id, round(list_dot_product(q.v, b.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-9) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-9)), 9) AS score FROM q, vec b JOIN embeddings e ON e.vec_id = b.id),
own AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, root ORDER BY score DESC, id) <= 3)
SELECT query_id, root, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM own QUALIFY rank <= 3""")
def per_root_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three best of each root (label), then the three best of all."""
    vectors, queries = G._vector_queries(spark, sf)
    hits = search.vector_scores(vectors, queries).join(vectors.select("id", F.col("label").alias("root")), "id").select("query_id", "root", "id", "score")
    return search.per_root(hits, 3).select("query_id", "root", "id", F.round("score", 6).alias("score"), "rank")


_ASKED = "harbor ledger covenant"


@query(f"""WITH {_ART}, {_CHU}, c AS (SELECT id, workspace, kind, name, artifact_id, text, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, coalesce(text, ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+'), lambda w: w <> '') AS w FROM chu),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM c), q AS (SELECT unnest(string_split('{_ASKED}', ' ')) AS term),
tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM c) JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
s AS (SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 6) AS score FROM tf JOIN df USING (term), n GROUP BY id),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s)
SELECT c.workspace, c.id, c.kind, c.name, a.path, CASE WHEN c.kind = 'page' AND regexp_full_match(c.name, 'p[0-9]{{1,9}}') THEN substr(c.name, 2)::INTEGER END AS page, round(1 / (60 + rank)::DOUBLE, 9) AS score FROM r JOIN c USING (id) JOIN art a ON a.id = c.artifact_id WHERE rank <= 8""")
def hybrid_found(spark: SparkSession, sf: str) -> DataFrame:
    """The search behind the engine's door, over the chunks of all workspaces."""
    chunks, artifacts = _tables(spark, sf, "chunks", "artifacts")
    return search.hybrid_search(chunks, artifacts, Graph(spark)["derived"], _ASKED).select("workspace", "id", "kind", "name", "path", "page", "score")


# ---- the write door ----


@query("SELECT DISTINCT name, CASE WHEN name = (SELECT min(name) FROM workspaces) THEN 'what calls what' ELSE intent END AS intent FROM workspaces UNION ALL SELECT 'another', 'new'")
def intents_set(spark: SparkSession, sf: str) -> DataFrame:
    graph = _graph(spark, sf, "workspaces")
    first = graph["workspaces"].agg(F.min("name")).first()[0]
    return write.set_intent(write.set_intent(graph, first, "what calls what"), "another", "new")["workspaces"].select("name", "intent")


@query(f"WITH {_ART}, {_CHU} SELECT c.id, c.workspace, a.lens FROM chu c JOIN art a ON a.id = c.artifact_id WHERE a.lens IS DISTINCT FROM 'prose'")
def unsynthesized_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that stay when what was synthesized goes; the artifacts of the lens for prose stand for that here."""
    arts = read.current_artifacts(_table(spark, sf, "artifacts")).withColumn("props", F.when(F.col("lens") == "prose", '{"provenance": "synthesized"}').otherwise('{"provenance": "primary"}'))
    graph = Graph(spark).with_tables(artifacts=arts, chunks=_table(spark, sf, "chunks").distinct(), mentions=_table(spark, sf, "mentions"))
    cleared = write.clear_synthesized(graph)
    return cleared["chunks"].join(cleared["artifacts"].select(F.col("id").alias("artifact_id"), "lens"), "artifact_id").select("id", "workspace", "lens")


@query(f"""WITH {_ENT}, l AS (SELECT workspace, name, etype, min(id) AS late FROM late_entities WHERE workspace IS NOT NULL AND name IS NOT NULL AND etype IS NOT NULL GROUP BY ALL),
old AS (SELECT workspace, name, etype, min(id) AS id FROM ent GROUP BY ALL)
SELECT l.workspace, l.name, l.etype, old.id AS kept_id, 'extracted' AS origin, l.late AS chunk_id FROM l LEFT JOIN old USING (workspace, name, etype)""")
def entities_by_hand(spark: SparkSession, sf: str) -> DataFrame:
    """The late entities entered by hand, each mentioned in a chunk of its number: known ones keep their id, props are replaced."""
    entities, late = _tables(spark, sf, "entities", "late_entities")
    rows = late.where("workspace is not null and name is not null and etype is not null").groupBy("workspace", "name", "etype").agg(F.min("id").alias("late")).select("workspace", "name", "etype", F.lit(None).cast("string").alias("props"), F.array("late").alias("chunk_ids"))
    graph = write.add_entities(Graph(spark).with_tables(entities=entities.distinct()), durable(rows, "late"))
    old = entities.groupBy("workspace", "name", "etype").agg(F.min("id").alias("kept_id"))
    made = graph["entities"].join(graph["mentions"].select(F.col("entity_id").alias("id"), "chunk_id"), "id").join(old, ["workspace", "name", "etype"], "left")
    return made.select("workspace", "name", "etype", "kept_id", T.json_text(F.col("props"), "$.origin").alias("origin"), "chunk_id")


_TWO = f"two AS (SELECT min(name) AS keep, max(name) AS gone, min(workspace) AS w FROM best WHERE workspace = (SELECT min(workspace) FROM best))"


@query(f"WITH {_ENT}, {_EDG}, {G._BEST}, {_TWO}, ids AS (SELECT k.id AS k, g.id AS g FROM two JOIN best k ON k.workspace = w AND k.name = keep JOIN best g ON g.workspace = w AND g.name = gone) SELECT edg.id, CASE WHEN src_id = g THEN k ELSE src_id END AS src_id, CASE WHEN dst_id = g THEN k ELSE dst_id END AS dst_id FROM edg, ids")
def merged_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after the last name of the first workspace is folded into its first."""
    graph = _graph(spark, sf, "entities", "mentions", "edges")
    named = graph["entities"].where("name is not null and workspace is not null and id is not null")
    first = named.agg(F.min("workspace")).first()[0]
    ends = named.where(F.col("workspace") == first).agg(F.min("name").alias("keep"), F.max("name").alias("gone")).first()
    return write.merge_by_name(graph, first, ends.keep, [ends.gone, "nobody of that name"])[0]["edges"].select("id", "src_id", "dst_id")


@query(f"""WITH {_ART}, two AS (SELECT workspace, arg_min(path, struct_pack(p := path, i := id)) AS a, arg_max(path, struct_pack(p := path, i := id)) AS b FROM art GROUP BY 1)
SELECT 'http' AS kind, '/made/{{}}' AS key, a AS client_path, 3::BIGINT AS client_line, b AS server_path, 4::BIGINT AS server_line, 0.9::DOUBLE AS confidence, 'llm' AS method, 0::BIGINT AS cross_repo FROM two WHERE workspace = (SELECT min(workspace) FROM two)""")
def asserted_binding(spark: SparkSession, sf: str) -> DataFrame:
    """A binding between the first and the last path of the first workspace, asserted twice: one row."""
    arts = durable(read.current_artifacts(_table(spark, sf, "artifacts")), "artifacts")
    graph = Graph(spark).with_tables(artifacts=arts)
    first = arts.agg(F.min("workspace")).first()[0]
    ends = arts.where(F.col("workspace") == first).agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    for line in (1, 4):
        graph, _ = write.assert_binding(graph, first, "http", "/made/{}", (ends.a, 3), (ends.b, line), 0.9, "by hand")
    return read.connections(graph["edges"], arts).select("kind", "key", "client_path", "client_line", "server_path", "server_line", "confidence", "method", "cross_repo")


# ---- lenses and rendering ----


@query("SELECT * FROM (VALUES ('code', 'coded', 1, 3), ('prose', 'coded', 1, 4), ('law', 'induced', 1, 1)) t(name, kind, version, extractors)")
def lens_list(spark: SparkSession, sf: str) -> DataFrame:
    """The lenses after one was registered, and once more in vain."""
    graph, _ = lens.register_lens(Graph(spark), lens.Lens("law", extractors=["defined-term-pattern"]))
    graph, _ = lens.register_lens(graph, lens.Lens("law"))
    rows = [(r.name, r.kind, r.version, len(lens.extractors_for(graph, r.name))) for r in lens.list_lenses(graph).collect()]
    return spark.createDataFrame(rows, "name string, kind string, version int, extractors int")


@query("SELECT doc_id, '<h2>' || replace(replace(replace(trim(coalesce(title, '')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h2>' || chr(10) || '<p>' || n_chars || ' &lt; ' || (n_chars + 1) || '</p>' AS html FROM documents")
def rendered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page of Markdown for each document, as HTML."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "html": [render.markdown_html(m) for m in batch.md]})

    n = F.col("n_chars").cast("long")
    md = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), n, F.lit(" < "), n + 1)
    return _table(spark, sf, "documents").select("doc_id", md.alias("md")).mapInPandas(work, "doc_id long, html string")


_ROOT = lambda c: f"array_to_string(string_split(replace({c}, chr(92), '/'), '/')[1:4], '/')"
_LABEL = lambda c: f"trim(translate({c}, '\"`' || chr(10), ''''' '))"
_BASE = lambda c: f"string_split(replace({c}, chr(92), '/'), '/')[-1]"


@query(f"""WITH {_ART}, {_EDG}, {G._BIND}, c AS (SELECT b.workspace, b.kind, b.key, b.cross_repo, x.path AS cp, y.path AS sp, {_ROOT('x.path')} AS cr, {_ROOT('y.path')} AS sr FROM bound b JOIN art x ON x.id = ca JOIN art y ON y.id = sa WHERE b.confidence >= 0),
ends AS (SELECT DISTINCT workspace, cr AS root, cp AS path FROM c UNION SELECT DISTINCT workspace, sr, sp FROM c),
nodes AS (SELECT workspace, path, min({_BASE('root')}) AS root, 'n' || (row_number() OVER (PARTITION BY workspace ORDER BY path) - 1) AS node FROM ends GROUP BY workspace, path),
arrows AS (SELECT DISTINCT c.workspace, 3 AS part, '' AS box, 0 AS k, '  ' || a.node || CASE WHEN cross_repo = 1 THEN ' ==>' ELSE ' -->' END || '|"' || {_LABEL("concat_ws(' ', kind, key)")} || '"| ' || b.node AS line FROM c JOIN nodes a ON a.workspace = c.workspace AND a.path = cp JOIN nodes b ON b.workspace = c.workspace AND b.path = sp),
heads AS (SELECT DISTINCT workspace, 0 AS part, '' AS box, 0 AS k, 'flowchart LR' AS line FROM c),
rows AS (SELECT workspace, root, '    ' || node || '["' || {_LABEL(_BASE('path'))} || '"]' AS line FROM nodes),
boxes AS (SELECT DISTINCT workspace, 1 AS part, root AS box, 0 AS k, '  subgraph ' || regexp_replace(root, '[^A-Za-z0-9_]', '_', 'g') || '["' || {_LABEL('root')} || '"]' AS line FROM nodes
  UNION ALL SELECT workspace, 1, root, row_number() OVER (PARTITION BY workspace, root ORDER BY line), line FROM rows UNION ALL SELECT workspace, 1, root, count(*) + 1, '  end' FROM nodes GROUP BY workspace, root),
every AS (SELECT * FROM arrows UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM boxes)
SELECT workspace, row_number() OVER (PARTITION BY workspace ORDER BY part, box, k, line) AS line_no, line FROM every""")
def diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """Flow charts of every workspace's connections."""
    edges, artifacts = _tables(spark, sf, "edges", "artifacts")
    root = lambda c: F.array_join(F.slice(F.split(F.translate(c, "\\", "/"), "/"), 1, 4), "/")
    rows = read.connections(edges, artifacts).withColumn("client_root", root("client_path")).withColumn("server_root", root("server_path"))
    return render.diagram_lines(rows)


QUERIES = G.QUERIES
SQL = G.SQL
