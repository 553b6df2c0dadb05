"""Extractors as functions from graph to graph, and the ingest that composes them.

Registered extractors take a graph, a workspace and a configuration, and return the graph and
counts.  Each replaces what it produced before, so running it again changes nothing.
Extractors never overwrite entities that were added by hand (origin ``extracted``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import extract, link, resolve, write
from weftgraph.operators.read import typed_connectors
from weftgraph.plans import lens as lenses
from weftgraph.plans.durable import durable, shared_dir
from weftgraph.schema import KEYS
from weftgraph.sources import files
from weftgraph.sources.store import Graph, conform

Extractor = Callable[[Graph, str, dict], tuple[Graph, dict]]
_REGISTRY: dict[str, Extractor] = {}
#: Named but not run here: to come, and left to a model.
PLANNED = {"sequence"}
MODEL_WORK = {"llm-type", "llm-relations", "llm-extract"}
DEFAULT = ["ast-callgraph", "doc-cross-source", "structural-binding"]


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Register an extractor under a name."""

    def add(f: Extractor) -> Extractor:
        _REGISTRY[name] = f
        return f

    return add


def registered() -> list[str]:
    return sorted(_REGISTRY)


def _here(graph: Graph, table: str, workspace: str) -> DataFrame:
    return graph[table].where(F.col("workspace") == workspace)


def _texts(graph: Graph, workspace: str, kinds: tuple[str, ...] = extract.TEXT_KINDS) -> DataFrame:
    return durable(extract.text_chunks(_here(graph, "chunks", workspace), _here(graph, "artifacts", workspace), kinds), "texts")


def _surface(graph: Graph, workspace: str, etype: str, origin: str, found: DataFrame, mentions: DataFrame) -> tuple[Graph, int]:
    """Replace an origin's entities by ``found`` (``name, props``) and their mentions (``name, chunk_id, surface``)."""
    graph = write.clear_origin(graph, workspace, origin)
    rows = found.select(F.lit(workspace).alias("workspace"), "name", F.lit(etype).alias("etype"), "props")
    rows = durable(rows.withColumn("id", link.entity_id(F.col("workspace"), F.col("name"), F.col("etype"))), "surfaced")
    graph = graph.append("entities", write.free_ids(graph["entities"], write.missing_rows(graph["entities"], conform(rows, "entities"), KEYS["entities"]), KEYS["entities"]))
    ids = graph["entities"].where((F.col("workspace") == workspace) & (F.col("etype") == etype)).select("name", F.col("id").alias("entity_id"))
    said = mentions.join(rows.select("name"), "name", "left_semi").join(ids, "name").groupBy("entity_id", "chunk_id", "surface").agg(F.count(F.lit(1)).alias("n"))
    each = said.select(F.lit(workspace).alias("workspace"), "entity_id", "chunk_id", "surface", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return graph.append("mentions", durable(each.withColumn("id", T.stable_id("entity_id", "chunk_id", "surface", F.lit(origin), "k")), "mentions")), rows.count()


@extractor("recurring-proper-nouns")
def proper_nouns(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    chunks = _texts(graph, workspace, ("docs", "pdf"))
    names = durable(extract.proper_noun_counts(chunks, int(config.get("min_count", 4)), int(config.get("top_k", 60))), "names")
    props = F.to_json(F.struct("first_page", "count", F.lit(True).alias("provisional"), F.lit("prose").alias("origin")))
    mentions = extract.proper_noun_mentions(chunks, names).select("name", "chunk_id", F.col("name").alias("surface"))
    graph, n = _surface(graph, workspace, config.get("etype", "character"), "prose", names.select("name", props.alias("props")), mentions)
    return graph, {"surfaced": n}


@extractor("salient-terms")
def salient_terms(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    chunks = _texts(graph, workspace)
    terms = durable(extract.salient_term_counts(chunks, int(config.get("min_count", 4)), int(config.get("top_k", 80))), "terms")
    props = F.to_json(F.struct(F.lit("salient-terms").alias("origin"), F.lit(True).alias("provisional"), "count"))
    said = chunks.select("chunk_id", F.explode(F.array_distinct(F.transform(T.phrases(F.col("text")), lambda p: F.lower(p)))).alias("term")).join(terms.select("term", "name"), "term")
    graph, n = _surface(graph, workspace, config.get("etype", "term"), "salient-terms", terms.select("name", props.alias("props")), said.select("name", "chunk_id", F.col("name").alias("surface")))
    return graph, {"salient_terms": n}


@extractor("defined-term-pattern")
def defined_terms(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    chunks = _texts(graph, workspace)
    origin = "defined-term-pattern"
    props = F.to_json(F.struct(F.lit(origin).alias("origin"), F.lit(True).alias("provisional"), "definition"))
    found = extract.defined_term_entities(chunks).select("name", props.alias("props"))
    graph, n = _surface(graph, workspace, config.get("etype", "defined_term"), origin, found, extract.defined_terms(chunks).select("name", "chunk_id", F.col("name").alias("surface")))
    return graph, {"defined_terms": n}


@extractor("structural-markers")
def markers(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    chunks = _texts(graph, workspace)
    etype = config.get("etype", "section")
    origin = f"structural-markers:{etype}"
    props = F.to_json(F.struct(F.lit(origin).alias("origin"), F.col("name").alias("label"), "line"))
    found = extract.marker_entities(chunks, config.get("preset")).select("name", props.alias("props"))
    graph, n = _surface(graph, workspace, etype, origin, found, extract.structural_markers(chunks, config.get("preset")).select("name", "chunk_id", F.col("name").alias("surface")))
    return graph, {"structural_markers": n}


def _replace(graph: Graph, table: str, gone: Column, new: DataFrame) -> tuple[Graph, int]:
    """Rows of a table without those that ``gone`` describes, with ``new``; where there are none of those, only the new are written."""
    new, is_gone = durable(new, table), F.coalesce(gone, F.lit(False))
    if not graph[table].where(is_gone).isEmpty():
        graph = graph.with_tables(**{table: graph[table].where(~is_gone)})
    return graph.append(table, new), new.count()


def _replace_edges(graph: Graph, gone: Column, new: DataFrame) -> tuple[Graph, int]:
    return _replace(graph, "edges", gone, new)


@extractor("co-occurrence")
def co_occurrence(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    pairs = link.cooccurrence(_here(graph, "mentions", workspace), graph["chunks"], int(config.get("min_cooccur", 2)))
    new = pairs.select(
        T.stable_id("workspace", "src_id", "dst_id", F.lit("co_occurs")).alias("id"), "workspace", "src_id", "dst_id", F.lit("co_occurs").alias("edge_type"), F.lit(0).alias("cross_source"), "confidence",
        F.lit("co-occurrence").alias("method"), F.lit(1).alias("asserted"), F.to_json(F.struct("shared", "first_page")).alias("props"),
    )
    graph, n = _replace_edges(graph, (F.col("workspace") == workspace) & (F.col("edge_type") == "co_occurs"), new)
    return graph, {"co_occurs": n}


@extractor("doc-cross-source")
def doc_cross_source(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    tables = [_here(graph, t, workspace) for t in ("entities", "mentions", "chunks", "artifacts")]
    # a symbol lies where it is defined; only one that is defined nowhere lies where it is called
    defined = link.grounded(tables[0], tables[1].where(~link.is_call_mention()), *tables[2:], ("code",)).where("etype = 'symbol'")
    code = defined.unionByName(link.grounded(*tables, ("code",)).where("etype = 'symbol'").join(defined.select("entity_id").distinct(), "entity_id", "left_anti"))
    links = link.doc_code_links(link.grounded(*tables, ("docs", "pdf")), code)
    new = links.select(
        T.stable_id("workspace", "src_id", "dst_id", F.lit("doc_describes_code")).alias("id"), "workspace", "src_id", "dst_id", F.lit("doc_describes_code").alias("edge_type"), F.lit(1).alias("cross_source"), "confidence", "method",
        F.to_json(F.struct("name", "code_symbol", "doc_chunk", "code_chunk")).alias("provenance"), F.lit(1).alias("asserted"),
    ).dropDuplicates(["src_id", "dst_id"])
    graph, n = _replace_edges(graph, (F.col("workspace") == workspace) & (F.col("edge_type") == "doc_describes_code"), new)
    return graph, {"cross_source_edges": n}


def _sources(graph: Graph, workspace: str) -> DataFrame:
    """``artifact_id, path, lang, text`` of code artifacts, read again from their files where the tasks are."""
    code = _here(graph, "artifacts", workspace).where("kind = 'code'").select(F.col("id").alias("artifact_id"), "path", "lang")
    return code.join(files.read_texts(code.select("path").distinct()), "path").where("text is not null")


def endpoints(graph: Graph, workspace: str, with_specs: bool = True) -> DataFrame:
    """``workspace, kind, role, key, artifact_id, path, line, root`` of a workspace's code, and of connectors from specifications."""
    found = extract.connectors(_sources(graph, workspace)).select("artifact_id", "kind", "role", "key", "line")
    if with_specs:
        found = found.unionByName(typed_connectors(_here(graph, "edges", workspace)).select("artifact_id", "kind", "role", "key", "line"))
    arts = _here(graph, "artifacts", workspace).select(F.col("id").alias("artifact_id"), "workspace", "path")
    return link.root_of(found.join(arts, "artifact_id"), _here(graph, "sources", workspace))


@extractor("structural-binding")
def structural_binding(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    made = link.bind(endpoints(graph, workspace))
    new = made.select(
        T.stable_id(*made.columns).alias("id"), "workspace", F.lit("binding").alias("edge_type"), F.lit(0).alias("cross_source"), "confidence", F.lit("structural").alias("method"), F.to_json(F.struct("kind", "key")).alias("provenance"),
        F.lit(1).alias("asserted"), F.to_json(F.struct("kind", "key", "client_artifact", "client_line", "server_artifact", "server_line", "cross_repo")).alias("props"),
    )
    graph, n = _replace_edges(graph, (F.col("workspace") == workspace) & (F.col("edge_type") == "binding") & (F.col("method") == "structural"), new)
    return graph, {"structural_bindings": n}


@extractor("ast-callgraph")
def call_graph(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    calls = files.call_pairs(_sources(graph, workspace)).withColumn("workspace", F.lit(workspace))
    symbols = _here(graph, "entities", workspace).where("etype = 'symbol'").select("workspace", "id", "name")
    calls = durable(calls, "calls")
    edges, new = link.call_edges(calls, symbols)
    fresh = durable(new.withColumn("etype", F.lit("symbol")), "symbols")
    new_edges = edges.select("id", "workspace", "src_id", "dst_id", F.lit("calls").alias("edge_type"), F.lit(0).alias("cross_source"), "confidence", "method", F.lit(1).alias("asserted"))
    said = durable(link.call_mentions(calls, symbols.unionByName(fresh.select("workspace", "id", "name")), _here(graph, "chunks", workspace)), "mentions")
    graph = graph if fresh.isEmpty() else graph.append("entities", fresh)
    graph, _ = _replace(graph, "mentions", (F.col("workspace") == workspace) & link.is_call_mention(), said)
    graph, n = _replace_edges(graph, (F.col("workspace") == workspace) & (F.col("edge_type") == "calls") & (F.col("method") == "structural"), new_edges)
    return graph, {"calls": n}


@extractor("cross-reference")
def cross_reference(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    etype, relation = config.get("etype", "section"), config.get("relation", "references")
    sections = _here(graph, "entities", workspace).where(F.col("etype") == etype).select("workspace", "id", "name")
    refs = extract.cross_references(_texts(graph, workspace), sections)
    new = refs.select(T.stable_id("workspace", "src_id", "dst_id", F.lit(relation)).alias("id"), "workspace", "src_id", "dst_id", F.lit(relation).alias("edge_type"), F.lit(0).alias("cross_source"), F.lit(0.7).alias("confidence"), F.lit("cross-reference").alias("method"), F.lit(1).alias("asserted"))
    graph, n = _replace_edges(graph, (F.col("workspace") == workspace) & (F.col("edge_type") == relation) & (F.col("method") == "cross-reference"), new)
    return graph, {"cross_references": n}


@extractor("alias-merge")
def alias_merge(graph: Graph, workspace: str, config: dict) -> tuple[Graph, dict]:
    """Fold entities of equal normalised name; with ``vectors`` (``id, vector``) in the configuration also those of similar names."""
    buckets = durable(resolve.alias_buckets(_here(graph, "entities", workspace), _here(graph, "mentions", workspace), config.get("etype")), "buckets")
    merges = buckets.where("id <> canonical_id").select(F.col("id").alias("old_id"), F.col("canonical_id").alias("new_id"))
    n = merges.count()
    graph = write.fuse(graph, merges)
    if config.get("embeddings", True) and config.get("vectors") is not None:
        ent = _here(graph, "entities", workspace)
        scope = ent.select("id", F.concat_ws("\n", "workspace", F.coalesce("etype", F.lit(""))).alias("scope"))
        near = resolve.similar_pairs(config["vectors"].join(scope, "id"), float(config.get("threshold", 0.9)))
        more = durable(resolve.canonical_map(resolve.linked_groups(near), ent, _here(graph, "mentions", workspace)), "merges")
        n += more.count()
        graph = write.fuse(graph, more)
    return graph, {"merged_entities": n}


def run_extractors(graph: Graph, workspace: str, items: list) -> tuple[Graph, dict]:
    """Run a composition in order; items are names, or dictionaries with ``use`` and a configuration.

    Names of model work come back under ``skill_extractors``, unknown ones under ``pending_extractors``.
    """
    counts: dict = {}
    for item in items:
        name, config = (item, {}) if isinstance(item, str) else (item.get("use") or item.get("name"), {k: v for k, v in item.items() if k not in ("use", "name")})
        if name in _REGISTRY:
            graph, said = _REGISTRY[name](graph, workspace, config)
            counts |= said
        else:
            counts.setdefault("skill_extractors" if name in MODEL_WORK else "pending_extractors", []).append(name)
    return graph, counts


def ingest(graph: Graph, path: str, workspace: str = "default", lens: str | None = None, provenance: str = "primary", pages_of: Callable[[bytes], list[str] | None] = files.fitz_pages, derived: str | None = None) -> tuple[Graph, dict]:
    """Bring a file or folder into a workspace and run its lens's extractors.

    Files are upserted by path: ids stay, chunks, their mentions and connectors are made
    anew.  Pages of PDF (``pages_of``) are chunks, and files of their own below ``derived``, with rows
    that lead back to file and page; without a PDF library such files give no artifact.
    Returns the graph and counts per kind, with files that nothing takes as ``skipped``.
    """
    spark = graph.spark
    root = files.resolve(path)
    graph = write.add_source(write.create_workspace(graph, workspace), workspace, root)
    paths = durable(files.find(spark, root), "paths")
    read = durable(files.dispatch(files.read_texts(paths)), "files")
    counts = {"code": 0, "spec": 0, "docs": 0, "pdf": 0, "skipped": 0} | {("skipped" if r.kind is None else r.kind): r.n for r in read.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    pages = durable(files.pdf_pages(paths, pages_of), "pages") if counts["pdf"] else spark.createDataFrame([], "path string, page int, pages int, text string")

    lang = F.when(F.col("kind") == "code", files.language(F.col("path"))).when(F.col("kind") == "spec", "openapi")
    texts = read.where("kind is not null and kind <> 'pdf'").select("path", "kind", lang.alias("lang"), T.sha16(F.col("text")).alias("sha"))
    paged = pages.select("path", F.lit("pdf").alias("kind"), F.lit(None).cast("string").alias("lang"), T.sha16(F.concat("path", F.col("pages").cast("string"))).alias("sha")).distinct()
    said = F.to_json(F.struct(F.lit(provenance).alias("provenance")))
    rows = texts.unionByName(paged).select("*", F.lit(workspace).alias("workspace"), F.lit(lens).alias("lens"), said.alias("props"), F.current_timestamp().alias("ingested_at"))
    graph = write.stamp_below(write.upsert_artifacts(graph, durable(rows, "artifacts")), workspace, root, lens, provenance)
    ids = graph["artifacts"].where(F.col("workspace") == workspace).select("path", F.col("id").alias("artifact_id"))
    texts = durable(read.where("kind is not null and kind <> 'pdf'").select("path", "kind", lang.alias("lang"), "text").join(ids, "path"), "texts")
    if counts["pdf"]:
        folder = f"{derived or (graph.home or shared_dir(spark)) + '/derived'}/{workspace}"
        made = durable(files.derived_pages(pages, folder.removeprefix("file://")).withColumn("workspace", F.lit(workspace)), "derived")
        graph = write.add_source(graph.append("derived", durable(write.missing_rows(graph["derived"], conform(made, "derived"), ["workspace", "derived_path"]), "fresh")), workspace, folder.removeprefix("file://"))

    empty = F.lit(None)
    symbol, mention, endpoint = F.lit("symbol"), F.lit("mention"), F.lit("endpoint")
    code = files.code_chunks(texts.where("kind = 'code'")).select("artifact_id", "ord", "kind", "name", "start_line", "end_line", "text", F.transform(F.array_distinct("symbols"), lambda s: F.struct(s.alias("name"), symbol.alias("etype"), s.alias("surface"))).alias("said"))
    spec = durable(files.spec_chunks(texts.where("kind = 'spec'")), "endpoints")
    specs = spec.select("artifact_id", "ord", F.lit("endpoint").alias("kind"), "name", "start_line", empty.cast("int").alias("end_line"), "text", F.array(F.struct(F.col("route").alias("name"), endpoint.alias("etype"), F.col("route").alias("surface"))).alias("said"))
    prose = files.doc_chunks(texts.where("kind = 'docs'")).withColumn("kind", F.lit("section")).unionByName(files.page_chunks(pages.join(ids, "path")).withColumn("kind", F.lit("page")))
    for c in files.registered():
        prose = prose.unionByName(c.chunk(texts.where(F.col("kind") == c.name)).select("artifact_id", "ord", "name", "text", F.lit("section").alias("kind")))
    spans = F.filter(F.transform(F.regexp_extract_all(F.col("text"), F.lit(extract.P.CODE_SPAN), F.lit(1)), lambda s: F.struct(T.span_symbol(s).alias("name"), mention.alias("etype"), s.alias("surface"))), lambda x: x["name"].isNotNull())
    docs = prose.select("artifact_id", "ord", "kind", "name", empty.cast("int").alias("start_line"), empty.cast("int").alias("end_line"), "text", spans.alias("said"))
    every = code.unionByName(specs).unionByName(docs)
    every = every.select(T.stable_id(F.lit(workspace), "artifact_id", "kind", "ord", "name").alias("id"), F.lit(workspace).alias("workspace"), *every.columns)
    every = write.free_ids(graph["chunks"], every, ["artifact_id", "kind", "ord", "name"])

    named = every.select("workspace", F.col("id").alias("chunk_id"), F.inline("said")).groupBy("workspace", "chunk_id", "name", "etype").agg(F.min("surface").alias("surface"))
    named = durable(named, "said")
    found = named.select("workspace", "name", "etype", link.entity_id(F.col("workspace"), F.col("name"), F.col("etype")).alias("id")).distinct()
    graph = graph.append("entities", write.free_ids(graph["entities"], write.missing_rows(graph["entities"], conform(found, "entities"), KEYS["entities"]), KEYS["entities"]))
    known = graph["entities"].where(F.col("workspace") == workspace).select("name", "etype", F.col("id").alias("entity_id"))
    mentions = named.join(known, ["name", "etype"]).select(T.stable_id("entity_id", "chunk_id", F.lit("ingest")).alias("id"), "workspace", "entity_id", "chunk_id", "surface")
    served = files.spec_connectors(spec)
    wires = served.select(
        T.stable_id(F.lit(workspace), *served.columns).alias("id"), F.lit(workspace).alias("workspace"), F.lit("connector").alias("edge_type"), F.lit(0).alias("cross_source"), F.lit("structural").alias("method"), F.lit(1).alias("asserted"),
        F.to_json(F.struct("kind", "role", F.col("key").alias("key_norm"), F.col("raw").alias("key_raw"), "artifact_id", "line")).alias("props"),
    )
    graph = lenses.ensure_seeded(graph.append("chunks", every).append("mentions", mentions).append("edges", wires)).settled()
    items = (lenses.extractors_for(graph, lens) if lens else None) or DEFAULT
    graph, more = run_extractors(graph, workspace, items)
    return graph.settled(), counts | more
