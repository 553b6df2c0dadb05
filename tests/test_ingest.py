"""Files to graph: kinds, chunks, links, and that doing it twice changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import read, write
from weftgraph.plans import compose, lens
from weftgraph.sources import files, parsers
from weftgraph.sources.store import Graph, Store

PY = '''import requests


class Keeper:
    def open_gate(self):
        return mend_fence(1)


def mend_fence(x):
    return requests.get("http://svc.example/pens/:id")


def main():
    mend_fence(2)
    other_thing()
'''
SERVER = '@app.get("/pens/{pen}")\ndef pens():\n    pass\n\nbus.publish(1, "hay.moved")\n'
MD = "Before.\n\n# Fences\nCall `mend_fence(3)` or `openGate`.\n\nSECTION 2. GATES\nSee Section 1 and `x`.\n"
SPEC = 'openapi: 3.0.0\ninfo: {title: Pens}\npaths:\n  /pens/{id}:\n    get: {summary: One pen}\n  /health:\n    get: {}\n'


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("farm")
    for name, text in {"client/_pkg/__init__.py": PY, "server/main.py": SERVER, "docs/guide.md": MD, "docs/api.yaml": SPEC, "docs/plain.yaml": "a: 1\n", "node_modules/x.py": "def no(): pass", "server/tool.rb": "def ruby_one\nend\n", "docs/empty.txt": ""}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="module")
def ingested(spark, corpus):
    graph = write.add_source(write.add_source(Graph(spark), "w", str(corpus / "client")), "w", str(corpus / "server"))
    return compose.ingest(graph, str(corpus), "w")


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_counts_and_walk(ingested, corpus):
    graph, counts = ingested
    assert {k: counts[k] for k in ("code", "docs", "spec", "pdf", "skipped")} == {"code": 3, "docs": 2, "spec": 1, "pdf": 0, "skipped": 1}
    assert any(p.endswith("_pkg/__init__.py") for p in files.walk(corpus)) and not any("node_modules" in p for p in files.walk(corpus))
    assert files.inspect(corpus)["file_count"] == 7
    assert files.inspect(corpus / "nothing")["error"]
    assert files.inspect(corpus / "docs/guide.md")["sample_text"] == MD


def test_chunks(ingested):
    graph, _ = ingested
    got = rows(graph["chunks"], "kind", "name", "start_line")
    assert {("class", "Keeper", 4), ("function", "open_gate", 5), ("function", "mend_fence", 9), ("file", "tool.rb", 1), ("section", "guide.md", None), ("section", "Fences", None), ("section", "SECTION 2. GATES", None), ("endpoint", "GET /pens/{id}", 4), ("section", "empty.txt", None)} <= got


def test_links(ingested):
    graph, counts = ingested
    names = {r.id: r.name for r in graph["entities"].collect()}
    edges = {(e.edge_type, names.get(e.src_id), names.get(e.dst_id), e.method) for e in graph["edges"].collect()}
    assert ("calls", "open_gate", "mend_fence", "structural") in edges and ("calls", "main", "other_thing", "structural") in edges
    assert ("doc_describes_code", "mend_fence", "mend_fence", "exact") in edges and ("doc_describes_code", "openGate", "open_gate", "fuzzy") in edges
    bound = read.connections(graph["edges"], graph["artifacts"]).collect()
    assert {(b.key, b.cross_repo) for b in bound} == {("/pens/{}", 1)} and {b.server_path.split("/")[-1] for b in bound} == {"main.py", "api.yaml"}
    assert counts["structural_bindings"] == 2


def test_call_mentions(spark, tmp_path):
    (tmp_path / "a.py").write_text("def bale():\n    return 1\n\ndef stack():\n    bale()\n    lift_up(bale())\n\ndef stack():\n    drop()\n\nlost()\n")
    (tmp_path / "a.md").write_text("# One\nUse `lift_up(1)` and `bale()`.\n")
    graph, _ = compose.ingest(Graph(spark), str(tmp_path), "c")

    def said(g):
        names, places = g["entities"].select(F.col("id").alias("entity_id"), "name", "etype"), g["chunks"].where("kind = 'function'").select(F.col("id").alias("chunk_id"), "start_line")
        return sorted(tuple(r) for r in g["mentions"].join(names.where("etype = 'symbol'"), "entity_id").join(places, "chunk_id").select("name", "start_line", "surface").collect())

    want = [("bale", 1, "bale"), ("bale", 4, "bale"), ("bale", 4, "bale"), ("drop", 4, "drop"), ("lift_up", 4, "lift_up"), ("stack", 4, "stack"), ("stack", 8, "stack")]
    assert said(graph) == want
    ids = {(r.name, r.etype): r.id for r in graph["entities"].collect()}
    lines = {r.id: r.start_line for r in graph["chunks"].collect()}
    links = {r.dst_id: r.code for r in graph["edges"].where("edge_type = 'doc_describes_code'").select("dst_id", F.get_json_object("provenance", "$.code_chunk").cast("long").alias("code")).collect()}
    assert {d: lines[c] for d, c in links.items()} == {ids["lift_up", "symbol"]: 4, ids["bale", "symbol"]: 1}
    again, more = compose.run_extractors(graph, "c", ["ast-callgraph", {"use": "co-occurrence", "min_cooccur": 1}])
    assert said(again) == want and again["mentions"].count() == again["mentions"].select("id").distinct().count()
    pairs = {frozenset(r) for r in again["edges"].where("edge_type = 'co_occurs'").select("src_id", "dst_id").collect()}
    assert frozenset([ids["stack", "symbol"], ids["lift_up", "symbol"]]) in pairs
    merged, _ = write.merge_by_name(graph, "c", "bale", ["drop"])
    assert [x for x in said(compose.run_extractors(merged, "c", ["ast-callgraph"])[0]) if x[2] == "drop"] == [("drop", 4, "drop")]


def test_twice_is_once(ingested, corpus, spark):
    graph, counts = ingested
    again, more = compose.ingest(graph, str(corpus), "w")
    assert more == counts
    for t in ("artifacts", "chunks", "entities", "edges"):
        assert again[t].count() == graph[t].count(), t
    assert rows(again["artifacts"], "id", "path") == rows(graph["artifacts"], "id", "path")


def test_provenance_and_clear(ingested, corpus, tmp_path):
    graph, _ = ingested
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/page.md").write_text("# Made\n`mend_fence`\n")
    more, _ = compose.ingest(graph, str(tmp_path / "wiki"), "w", provenance="synthesized")
    said = {r.provenance for r in read.list_artifacts(more["artifacts"]).collect()}
    assert said == {"primary", "synthesized"}
    cleared = write.clear_synthesized(more, "w")
    assert cleared["artifacts"].count() == graph["artifacts"].count() and cleared["chunks"].count() == graph["chunks"].count()


def test_snapshots(ingested, spark, tmp_path):
    graph, _ = ingested
    store = Store(spark, str(tmp_path / "store"))
    assert store.read()["entities"].count() == 0
    assert store.write(graph) == 1 and store.write(graph.with_tables(edges=graph["edges"].limit(1))) == 2
    assert store.read()["edges"].count() == 1 and store.read(1)["edges"].count() == graph["edges"].count()


def test_assert_binding(ingested):
    graph, _ = ingested
    made, said = write.assert_binding(graph, "w", "http", "/made/{}", ("_pkg/__init__.py", 3), ("server/main.py", 2), rationale="built at run time")
    assert said["ok"] and said["cross_repo"] == 1
    made, _ = write.assert_binding(made, "w", "http", "/made/{}", ("_pkg/__init__.py", 3), ("server/main.py", 2))
    assert made["edges"].where("method = 'llm'").count() == 1
    again, _ = compose.run_extractors(made, "w", ["structural-binding", "llm-type", "sequence"])
    assert again["edges"].where("method = 'llm'").count() == 1
    assert not write.assert_binding(graph, "w", "http", "k", ("nowhere.py", 1), ("server/main.py", 2))[1]["ok"]


def test_scanners():
    rust = "struct Pen { n: i32 }\nimpl Pen {\n    fn open(&self) { latch(); }\n}\nfn latch() {}\nfn main() { let p = Pen { n: 1 }; p.open(); println!(\"latch()\"); }\n"
    assert {(d.kind, d.name) for d in parsers.definitions(rust, "rust")} == {("struct", "Pen"), ("function", "open"), ("function", "latch"), ("function", "main")}
    assert {("open", "latch"), ("main", "open")} <= set(parsers.calls(rust, "rust"))
    ts = "interface Gate { n: number }\nclass Yard {\n  public swing(a: number): void {\n    this.latch(a);\n  }\n  latch(a: number) { return helper(a); }\n}\nfunction helper(a) { return a; } // helper()\n"
    assert {("interface", "Gate"), ("class", "Yard"), ("method", "swing"), ("method", "latch"), ("function", "helper")} == {(d.kind, d.name) for d in parsers.definitions(ts, "typescript")}
    assert set(parsers.calls(ts, "typescript")) == {("swing", "latch"), ("latch", "helper")}
    assert parsers.definitions("def broken(:", "python") == [] and parsers.calls("x", "go") == []


BROKEN = '''"""Notes."""

def first(a, b=seed()):
    """It's the "first" one: def not_one(x):"""
    global = latch(a)
    return [mend(
        b), f"{fit(a)}"]

Roughly 27 sacks (see item 3) were Ravimstead's, “said” nobody(kept
    tail = hinge(a)

class Yard(Base):
    def open(self):
        if self.shut(): self.swing ()
        x = = lift(1)

    def shut(self):
        """A quote that never ends.
        return bolt(2)

async def last():
    await drain()

def broken(:
def bare(x):
'''


def test_broken_python():
    found = parsers.definitions(BROKEN, "python")
    assert [(d.kind, d.name, d.start_line, d.end_line) for d in found] == [("function", "first", 3, 10), ("class", "Yard", 12, 19), ("function", "open", 13, 15), ("function", "shut", 17, 19), ("function", "last", 21, 22), ("function", "bare", 25, 25)]
    assert all(BROKEN[d.begin : d.end] == d.text and d.text.rstrip() == d.text for d in found)
    calls = parsers.calls(BROKEN, "python")
    assert sorted(calls) == sorted([("first", x) for x in ("seed", "latch", "mend", "fit", "hinge")] + [("open", "shut"), ("open", "swing"), ("open", "lift"), ("shut", "bolt"), ("last", "drain")])
    assert parsers.calls("x = = 1\n" + PY, "python") == parsers.calls(PY, "python") and len(parsers.definitions("x = = 1\n" + PY, "python")) == 4


def test_broken_python_is_searchable(spark, tmp_path):
    (tmp_path / "notes.py").write_text(BROKEN)
    graph, _ = compose.ingest(Graph(spark), str(tmp_path), "b")
    assert ("function", "first", 3) in rows(graph["chunks"], "kind", "name", "start_line") and graph["edges"].where("edge_type = 'calls'").count() == 10


def test_prose_lens(spark, tmp_path):
    text = "# one\nMira Vale met Odo Finch. Mira Vale left.\n# two\nOdo Finch saw Mira Vale and Odo Finch.\n# three\nMira Vale and Odo Finch.\n"
    (tmp_path / "book.md").write_text(text)
    graph, counts = compose.ingest(Graph(spark), str(tmp_path), "b", lens="prose")
    assert counts["surfaced"] == 2 and counts["co_occurs"] == 1
    edge = graph["edges"].where("edge_type = 'co_occurs'").first()
    assert edge.confidence == pytest.approx(0.7)
    graph = write.classify(graph, spark.createDataFrame([("b", "Mira Vale", "person"), ("b", "Odo Finch", "drop")], "workspace string, name string, type string"))
    assert rows(graph["entities"], "name", "etype") == {("Mira Vale", "person")} and graph["edges"].count() == 0
    pending = read.pending_entities(graph["entities"], graph["mentions"], graph["chunks"])
    assert pending.count() == 0


def test_lenses(spark):
    graph = lens.ensure_seeded(Graph(spark))
    assert [r.name for r in lens.list_lenses(graph).collect()] == ["code", "prose"]
    mine = lens.Lens(name="law", extractors=["defined-term-pattern"], entity_types=["term"])
    graph, said = lens.register_lens(graph, mine)
    assert said["ok"] and lens.get_lens(graph, "law")["kind"] == "induced" and lens.extractors_for(graph, "law") == ["defined-term-pattern"]
    graph, said = lens.register_lens(graph, lens.Lens(name="law", extractors=[]))
    assert not said["ok"] and lens.extractors_for(graph, "law") == ["defined-term-pattern"]
    assert lens.get_lens(graph, "none") is None and lens.extractors_for(graph, "none") == []


def test_surfacers(spark, tmp_path):
    text = 'SECTION 1. TERMS\n"Fee" means a sum. (the "Agent") and "Loan": it. Interest is defined as a part. see Section 2\nSECTION 2. MORE\nSee section 1 and Section 10.\nSECTION 10. LAST\n'
    (tmp_path / "deal.txt").write_text(text)
    base, _ = compose.ingest(Graph(spark), str(tmp_path), "d")
    graph, counts = compose.run_extractors(base, "d", ["defined-term-pattern", {"use": "structural-markers", "preset": "section"}, "cross-reference", {"use": "salient-terms", "min_count": 2}])
    terms = {r.name for r in graph["entities"].where("etype = 'defined_term'").collect()}
    assert {"Fee", "Agent", "Interest"} <= terms and "Loan" not in terms
    marks = {r.name: r.id for r in graph["entities"].where("etype = 'section'").collect()}
    assert set(marks) == {"SECTION 1.", "SECTION 2.", "SECTION 10."}
    refs = {(e.src_id, e.dst_id) for e in graph["edges"].where("method = 'cross-reference'").collect()}
    assert (marks["SECTION 1."], marks["SECTION 2."]) in refs and (marks["SECTION 2."], marks["SECTION 1."]) in refs
    again, more = compose.run_extractors(graph, "d", ["defined-term-pattern"])
    assert more["defined_terms"] == counts["defined_terms"] and again["entities"].count() == graph["entities"].count()


def test_registered_source(spark, tmp_path):
    (tmp_path / "list.csv").write_text("a,b\n")
    files.register(files.Chunker("table", lambda p, t: p.endswith(".csv"), lambda df: df.select("artifact_id", F.lit(0).cast("long").alias("ord"), F.lit("rows").alias("name"), "text")))
    try:
        graph, counts = compose.ingest(Graph(spark), str(tmp_path), "r")
        assert counts["table"] == 1 and rows(graph["chunks"], "name") == {("rows",)}
    finally:
        files._REGISTRY.clear()


def test_pages_are_derived_and_cited(spark, tmp_path):
    corpus = tmp_path / "c"
    corpus.mkdir()
    (corpus / "Deed of 1.pdf").write_bytes(b"The `verify_gate` deed.\fSecond page\xff\f")
    (corpus / "note.md").write_text("# n\n")
    pages = lambda content: content.decode("utf-8", "ignore").split("\f")
    graph, counts = compose.ingest(Graph(spark), str(corpus), "w", pages_of=pages, derived=str(tmp_path / "derived"))
    assert counts["pdf"] == 1 and rows(graph["chunks"].where("kind = 'page'"), "name", "text") == {("p1", "The `verify_gate` deed."), ("p2", "Second page"), ("p3", "")}
    made = graph["derived"].collect()
    assert {(r.orig_path, r.page) for r in made} == {(str(corpus / "Deed of 1.pdf"), n) for n in (1, 2, 3)}
    assert {open(r.derived_path).read() for r in made} == {"The `verify_gate` deed.", "Second page", ""}
    assert str(tmp_path / "derived/w") in {r.root_path for r in graph["sources"].collect()}
    hits = spark.createDataFrame([(1, made[0].derived_path)], "id long, path string")
    assert rows(read.original_place(hits, graph["derived"]), "path", "page") == {(made[0].orig_path, made[0].page)}
    again, more = compose.ingest(graph, str(corpus), "w", pages_of=pages, derived=str(tmp_path / "derived"))
    assert more == counts and again["derived"].count() == 3 and again["chunks"].count() == graph["chunks"].count()
    none, counts = compose.ingest(Graph(spark), str(corpus), "v", pages_of=lambda content: None)
    assert counts["pdf"] == 1 and rows(none["artifacts"], "kind") == {("docs",)} and none["derived"].count() == 0


def test_store_writes_only_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    graph = write.add_source(write.create_workspace(Graph(spark), "w"), "w", "/a").append("entities", spark.createDataFrame([(1, "w", "a", "t", None)], "id long, workspace string, name string, etype string, props string"))
    store.write(graph)
    first = store.manifest(1)
    row = spark.createDataFrame([("w", "b", "t", "{}", [5])], "workspace string, name string, etype string, props string, chunk_ids array<long>")
    store.write(write.add_entities(store.read(), row))
    second = store.manifest(2)
    assert second["workspaces"] == first["workspaces"] and second["sources"] == first["sources"]
    assert second["entities"][:1] == first["entities"] and len(second["entities"]) == 2 and len(second["mentions"]) == 1
    store.write(write.add_entities(store.read(), row))  # known: the table is written anew, once
    third = store.manifest(3)
    assert len(third["entities"]) == 1 and third["entities"] != first["entities"] and len(third["mentions"]) == 2
    assert rows(store.read()["entities"], "name") == {("a",), ("b",)} and store.read(1)["entities"].count() == 1
    assert store.vacuum(1) > 0 and store.versions() == [3] and store.read()["entities"].count() == 2
    store.write(graph)  # written elsewhere
    assert store.read()["entities"].count() == 1


def test_walk_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS", 2)
    for name in ("a/_x/__init__.py", "a/b/c/d.py", "e/.hidden", "e/node_modules/no.js", "top.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    want = {str(tmp_path / n) for n in ("a/_x/__init__.py", "a/b/c/d.py", "e/.hidden", "top.md")}
    assert set(files.walk(tmp_path)) == want == {r.path for r in files.find(spark, tmp_path).collect()}
    assert {r.path for r in files.find(spark, f"file://{tmp_path}").collect()} == {f"file://{w}" for w in want}
    assert files.find(spark, tmp_path / "nothing").count() == 0 and [r.path for r in files.find(spark, tmp_path / "top.md").collect()] == [str(tmp_path / "top.md")]


def test_colliding_ids_are_told_apart(spark):
    old = spark.createDataFrame([(1, "w", "a", "t"), (2, "w", "b", "t")], "id long, workspace string, name string, etype string")
    new = spark.createDataFrame([(1, "w", "c", "t"), (7, "w", "d", "t"), (7, "w", "e", None), (7, "v", "e", None), (8, None, "f", "t")], old.schema)
    got = {r.name + (r.workspace or ""): r.id for r in write.free_ids(old, new, ["workspace", "name", "etype"]).collect()}
    assert len(set(got.values())) == 5 and not {1, 2} & set(got.values()) and got["f"] == 8 and 7 in got.values()
    assert {r.name + (r.workspace or ""): r.id for r in write.free_ids(old, new.repartition(3), ["workspace", "name", "etype"]).collect()} == got
    assert write.free_ids(old, new.limit(0), ["workspace", "name", "etype"]).count() == 0
