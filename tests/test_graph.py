"""Extraction, linking, resolution, reading and writing on small cases, nulls and ties included."""

from __future__ import annotations

import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.paths import same_path, suffix
from weftgraph.operators import extract, link, read, render, resolve, search, write
from weftgraph.sources import files
from weftgraph.sources.store import Graph

CHUNK = "workspace string, chunk_id long, artifact_id long, name string, text string"
ENTITY = "id long, workspace string, name string, etype string, props string"
MENTION = "id long, workspace string, entity_id long, chunk_id long, surface string"
EDGE = "id long, workspace string, src_id long, dst_id long, edge_type string, cross_source int, confidence double, method string, asserted int, props string"


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def chunks(spark, rows):
    return spark.createDataFrame([(w, c, 1, n, t) for w, c, n, t in rows], CHUNK)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.symbol_key, "verify_JWT token-x", "verifyjwttokenx"), (T.entity_key, " The  Borrower's,  Bank ", "borrowers bank"), (T.entity_key, "...", ""), (T.entity_key, "The the Élan", "the élan"), (T.entity_key, None, None),
        (T.page_of, "p12", 12), (T.page_of, "p12\n", None), (T.page_of, "page 1", None), (T.span_symbol, " a.b.open_gate(x.y) ", "open_gate"), (T.span_symbol, "ab", None), (T.span_symbol, "a-b-c", None),
        (T.route_key, "https://h.example/a/:id/b/?q=1", "/a/{}/b"), (T.route_key, "/v1/<int:x>/", "/v1/{}"), (T.route_key, "/health", None), (T.route_key, "/a/b", None), (T.route_key, "http://h", None), (T.route_key, None, None),
        (T.one_line, " a\n\tb\u00a0c ", "a b c"), (T.slug, "Ein  Titel: öß!", "ein-titel"), (T.slug, "***", "artifact"), (T.safe_label, ' a"b`\nc', "a'b' c"),
        (same_path, "\\a\\\\b/./c", "/a/b/c"), (same_path, "./a", "a"), (same_path, None, None), (suffix, "/x/A.TAR.GZ", ".gz"), (suffix, "/x/.env", ""), (suffix, "C:\\x\\y.Py", ".py"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, "string", value, f) == want


def test_like_is_ascii_only(spark):
    df = spark.createDataFrame([("Über ABC",), ("über abc",), ("a\\b",), (None,)], "t string")
    n = lambda q: df.where(T.like_ascii(F.col("t"), q)).count()
    assert (n("abc"), n("ABC"), n("über"), n("a_c"), n("%"), n("a\\b")) == (2, 2, 1, 2, 3, 1)


def test_json_edits(spark):
    props = '{"a": [1, "x"], "aliases": ["q\\"r"], "p": true}'
    assert json.loads(one(spark, "string", props, lambda c: T.without_field(c, "p"))) == {"a": [1, "x"], "aliases": ['q"r']}
    assert json.loads(one(spark, "string", props, lambda c: T.with_field(c, "a", F.lit("5")))) == {"a": 5, "aliases": ['q"r'], "p": True}
    assert one(spark, "string", "n/a", lambda c: T.without_field(c, "p")) == "n/a" and one(spark, "string", None, lambda c: T.with_field(c, "p", F.lit("1"))) == '{"p":1}'


def test_proper_nouns_and_ties(spark):
    rows = [("w", 2, "p7", "Zed Moor and Ann Lee. The Ann. Ann Lee's"), ("w", 1, "intro", "Ann Lee met Zed Moor"), ("w", 3, None, None), ("w", 4, "p1", ""), ("v", 5, "p2", "Éva Stone saw Kit. Kit Kit Kit")]
    got = [(r.workspace, r.name, r["count"], r.first_page, r["rank"]) for r in extract.proper_noun_counts(chunks(spark, rows), 2, 2).orderBy("workspace", "rank").collect()]
    assert got == [("w", "Ann Lee", 3, 7, 1), ("w", "Zed Moor", 2, 7, 2)]
    assert extract.proper_noun_counts(chunks(spark, []), 1).count() == 0


def test_phrases(spark):
    text = "Fresh garam masala, the fresh Garam masala don't stop; été garam"
    got = one(spark, "string", text, T.phrases)
    assert Counter(p.lower() for p in got) == Counter("fresh,garam,masala,fresh garam,garam masala,fresh garam masala,fresh,garam,masala,fresh garam,garam masala,fresh garam masala,stop,garam".split(","))
    terms = {r.term: (r.name, r["count"]) for r in extract.salient_term_counts(chunks(spark, [("w", 1, "a", text), ("w", 2, "b", None)]), 2).collect()}
    assert terms["garam masala"] == ("garam masala", 2) and "stop" not in terms


def test_defined_terms(spark):
    text = 'x\n"Base  Rate": y "Fee" means z; (the “Agent”) and "Mid": no. Loan Book means a list. "A" means b'
    got = {r.name: (r.mentions, r.definition[:12]) for r in extract.defined_term_entities(chunks(spark, [("w", 1, "a", text), ("w", 2, "b", 'Fee. "Fee" shall mean q')])).collect()}
    assert got == {"Base Rate": (1, '"Base  Rate"'), "Fee": (2, '"Fee" means '), "Agent": (1, "(the “Agent”"), "Loan Book": (1, "Loan Book me")}


def test_markers(spark):
    text = "a\n\n\nSECTION 4. TERMS\n# Head #\nINT. BARN - DAY\nChapter One\n## " + "x" * 95
    got = {(r.name, r.line) for r in extract.marker_entities(chunks(spark, [("w", 1, "a", text)])).collect()}
    assert got == {("SECTION 4.", 2), ("Head #", 5), ("INT. BARN - DAY", 6), ("Chapter One", 7)}
    assert {r.name for r in extract.marker_entities(chunks(spark, [("w", 1, "a", text)]), "slugline").collect()} == {"INT. BARN - DAY"}


def test_cross_references(spark):
    secs = spark.createDataFrame([(1, "w", "SECTION 1"), (2, "w", "SECTION 2. B"), (10, "w", "SECTION 10"), (3, "w", "ARTICLE IV"), (4, "w", None), (5, "v", "SECTION 2")], "id long, workspace string, name string")
    rows = [("w", 1, "SECTION 2. B and more", "see section 10, § IV and Section 2"), ("w", 2, "ARTICLE", "Clause 1, clause 1"), ("w", 3, None, "Section 1"), ("w", 4, "other", "Section 1"), ("v", 5, "SECTION 2", "Section 2")]
    assert {(r.src_id, r.dst_id) for r in extract.cross_references(chunks(spark, rows), secs).collect()} == {(2, 10), (2, 3), (3, 1)}


def test_connectors(spark):
    text = 'import x\n@bp.route("/pens/<id>")\nrequests.get("http://h/pens/{n}/")\nrequests.get("http://h/pens/{n}/")\nfetch(`/health`)\nbus.send("hay.moved")\nq.consume(["hay.moved"])\nx.publish(1, \'no\')\n'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "artifact_id long, text string")
    got = {(r.kind, r.role, r.key, r.line) for r in extract.connectors(rows).collect()}
    assert got == {("http", "server", "/pens/{}", 2), ("http", "client", "/pens/{}", 3), ("topic", "client", "hay.moved", 6), ("topic", "server", "hay.moved", 7)}


def test_code_spans(spark):
    got = {(r.name, r.surface) for r in extract.code_spans(chunks(spark, [("w", 1, "a", "`x.open_gate(1)` `open_gate` `no` ``"), ("w", 2, "b", None)])).collect()}
    assert got == {("open_gate", "x.open_gate(1)")}


def test_cooccurrence(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("vw"), rng.choice([1, 1, *range(2, 12), None]), rng.choice([*range(30), None, 99]), None) for k in range(500)]
    ch = spark.createDataFrame([(c, f"p{c}" if c % 2 else "x") for c in range(30)] * 2, "id long, name string")
    got = {(r.workspace, r.src_id, r.dst_id): (r.shared, r.first_page, round(r.confidence, 6)) for r in link.cooccurrence(spark.createDataFrame(rows, MENTION), ch).collect()}
    held: dict = {}
    for _, w, e, c, _ in rows:
        if e is not None and c is not None and c < 30:
            held.setdefault((w, c), set()).add(e)
    n, first = Counter(), {}
    for (w, c), es in sorted(held.items(), key=lambda x: x[0][1]):
        for a, b in combinations(sorted(es), 2):
            n[(w, a, b)] += 1
            first.setdefault((w, a, b), c if c % 2 else None)
    assert got == {k: (v, first[k], round(min(1.0, 0.4 + 0.1 * v), 6)) for k, v in n.items() if v >= 2}


def test_bind_guard_and_self(spark):
    rows = [("w", "http", "client", "/hot/{}", i, 1, "r1") for i in range(9)] + [("w", "http", "server", "/hot/{}", 100 + i, 1, "r2") for i in range(5)]
    rows += [("w", "topic", "client", "t.x", 1, 5, "r1"), ("w", "topic", "server", "t.x", 1, 5, "r1"), ("w", "topic", "server", "t.x", 2, None, None), ("w", "topic", "client", "lost", 3, 1, None), ("w", "http", "client", None, 1, 1, "r")]
    df = spark.createDataFrame(rows, "workspace string, kind string, role string, key string, artifact_id long, line long, root string")
    got = {(r.key, r.client_artifact, r.server_artifact, r.cross_repo, r.confidence) for r in link.bind(df).collect()}
    assert got == {("t.x", 1, 2, 0, 0.7)}
    assert link.bind(df, 45).count() == 46
    free = {(r.role, r.key) for r in link.unbound(df.withColumn("path", F.lit("p"))).collect()}
    assert free == {("client", "lost")}


def test_doc_code_links(spark):
    code = spark.createDataFrame([("w", 5, "openGate", "symbol", 50, "code"), ("w", 4, "open_gate", "symbol", 40, "code"), ("w", 6, "abc", "symbol", 60, "code")], "workspace string, entity_id long, name string, etype string, chunk_id long, kind string")
    docs = spark.createDataFrame([("w", 1, "openGate", "m", 9, "docs"), ("w", 1, "openGate", "m", 3, "pdf"), ("w", 2, "Open-Gate", "m", 9, "docs"), ("w", 3, "a_b_c", "m", 9, "docs"), ("v", 7, "openGate", "m", 9, "docs")], code.schema)
    got = {(r.src_id, r.dst_id, r.method, r.doc_chunk) for r in link.doc_code_links(docs, code).collect()}
    assert got == {(1, 5, "exact", 3), (2, 4, "fuzzy", 9)}


def test_roots_and_spans(spark):
    places = spark.createDataFrame([("w", "/a/svc/x.py"), ("w", "/a/svc2/x.py"), ("w", "/a/svc/in/y.py"), ("w", None), ("v", "/a/svc/x.py")], "workspace string, path string")
    roots = spark.createDataFrame([("w", "/a/svc/"), ("w", "/a/svc/in"), ("v", "/")], "workspace string, root_path string")
    assert {(r.workspace, r.path): r.root for r in link.root_of(places, roots).collect()} == {("w", "/a/svc/x.py"): "/a/svc", ("w", "/a/svc2/x.py"): None, ("w", "/a/svc/in/y.py"): "/a/svc/in", ("w", None): None, ("v", "/a/svc/x.py"): None}
    points = spark.createDataFrame([(1, 5), (1, 3000), (1, 9), (2, 5), (1, None)], "owner long, at long")
    spans = spark.createDataFrame([(1, "outer", 0, 5000), (1, "inner", 4, 6), (1, "same", 4, 6), (1, "bad", 9, 8)], "owner long, name string, lo long, hi long")
    assert {(r.owner, r.at): r.name for r in link.narrowest(points, spans).collect()} == {(1, 5): "inner", (1, 3000): "outer", (1, 9): "outer", (2, 5): None, (1, None): None}


def test_alias_buckets_and_fuse(spark):
    rows = [(1, "w", "The Borrower", "party", '{"aliases": ["B"]}'), (2, "w", "Borrower", "party", None), (3, "w", "borrower", "party", "n/a"), (4, "w", "Borrower", "term", None), (5, "w", "...", "party", None), (6, "w", "!!", "party", None), (7, "v", "Borrower", "party", None), (8, "w", None, "party", None), (2, "w", "Borrower", "party", None)]
    entities = spark.createDataFrame(rows, ENTITY)
    mentions = spark.createDataFrame([(1, "w", 2, 1, "x"), (2, "w", 2, 2, "x"), (3, "w", 3, 1, "x"), (4, "w", None, 1, "x")], MENTION)
    got = {(r.id, r.canonical_id, r.bucket_size) for r in resolve.alias_buckets(entities, mentions).collect()}
    assert got == {(1, 2, 3), (2, 2, 3), (3, 2, 3)}
    edges = spark.createDataFrame([(1, "w", 1, 3, "x", 0, 1.0, "m", 1, None), (2, "w", 4, None, "x", 0, 1.0, "m", 1, None)], EDGE)
    graph = Graph(spark).with_tables(entities=entities.distinct(), mentions=mentions, edges=edges)
    merged = write.fuse(graph, spark.createDataFrame([(1, 2), (3, 2)], "old_id long, new_id long"))
    assert {(e.src_id, e.dst_id) for e in merged["edges"].collect()} == {(2, 2), (4, None)}
    assert {m.entity_id for m in merged["mentions"].collect()} == {2, None}
    kept = {e.id: e.props for e in merged["entities"].collect()}
    assert 1 not in kept and 3 not in kept and json.loads(kept[2])["aliases"] == ["B", "The Borrower", "borrower"]


def test_similar_pairs_and_groups(spark):
    rng = random.Random(2)
    vs = [(("s", "t")[i % 2], i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [("s", 100, None), ("s", 101, [1.0])]
    df = spark.createDataFrame(vs, "scope string, id long, vector array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = {(s, i, j) for s, i, a in vs[:60] for t, j, b in vs[:60] if s == t and i < j and cos(a, b) >= 0.8}
    assert {(r.scope, r.a, r.b) for r in resolve.similar_pairs(df, 0.8, block=7).collect()} == want
    pairs = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5), (20, 21)], "a long, b long")
    assert {tuple(r) for r in resolve.linked_groups(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6), (20, 20), (21, 20)}
    assert resolve.linked_groups(pairs.limit(0)).count() == 0


def test_neighbors(spark):
    ent = spark.createDataFrame([(1, "w", "Ann", "p", None), (2, "w", "Bob", "p", None), (3, "w", "Ann", "q", None), (4, "w", None, "p", None)], ENTITY)
    edges = spark.createDataFrame(
        [(1, "w", 1, 2, "co", 0, 0.9, "m", 1, '{"shared": 5}'), (2, "w", 2, 3, "co", 0, 0.8, "m", 1, '{"shared": 0}'), (3, "w", 1, 1, "loop", 0, None, "m", 1, "n/a"), (4, "w", 1, None, "co", 0, 1.0, "m", 1, None), (5, "w", 1, 3, "x", 0, 0.1, "m", 1, None), (1, "w", 1, 2, "co", 0, 0.9, "m", 1, '{"shared": 5}')], EDGE
    )
    got = [(r.entity, r.type, r.relation, r.weight) for r in read.neighbors(edges, ent, "Ann").collect()]
    assert got == [("Bob", "p", "co", 5.0), ("Bob", "p", "co", 0.0), ("Ann", "q", "x", None), ("Ann", "p", "loop", None)]
    assert [r.entity for r in read.neighbors(edges, ent, "Ann", relation="co", limit=1).collect()] == ["Bob"]
    assert read.neighbors(edges, ent, "Nobody").count() == 0
    assert {r.src for r in read.cross_edges(edges.withColumn("cross_source", F.lit(1)), ent, "Bob", 0.85).collect()} == {"Ann"}


def test_write_door(spark):
    graph = Graph(spark)
    new = spark.createDataFrame([("w", "Ann", "p", '{"x": 1}', [1, 2]), ("w", "Bob", "p", None, None)], "workspace string, name string, etype string, props string, chunk_ids array<long>")
    graph = write.add_entities(write.add_entities(graph, new), new)
    assert graph["entities"].count() == 2 and graph["mentions"].count() == 4
    assert {json.loads(r.props)["origin"] for r in graph["entities"].collect()} == {"extracted"}
    rel = spark.createDataFrame([("w", "Ann", "Bob", "knows", None, None, False), ("w", "Ann", "Cy", "knows", None, 0.5, True)], "workspace string, src string, dst string, relation string, props string, confidence double, asserted boolean")
    graph, bad = write.add_relations(graph, rel)
    edge = graph["edges"].collect()
    assert len(edge) == 1 and (edge[0].asserted, edge[0].confidence) == (0, 0.8) and [r.missing for r in bad.collect()] == ["Cy"]
    merged, n = write.merge_by_name(graph, "w", "Ann", ["Bob", "Nobody"])
    assert n == 1 and {(e.src_id == e.dst_id) for e in merged["edges"].collect()} == {True} and write.merge_by_name(graph, "w", "Zoe", ["Ann"])[1] == -1
    made = write.set_intent(write.create_workspace(graph, "w", "old"), "w", "new")
    assert [tuple(r) for r in made["workspaces"].select("name", "intent").collect()] == [("w", "new")]


def test_search(spark):
    docs = spark.createDataFrame([(1, "gate gate fence"), (2, "fence"), (3, None), (4, ""), (5, "gate")], "id long, text string")
    asked = spark.createDataFrame([(7, "Gate!"), (8, "nothing"), (9, None)], "query_id long, text string")
    got = [(r.query_id, r.id, r["rank"]) for r in search.bm25(docs, asked).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1), (7, 5, 2)] or got == [(7, 5, 1), (7, 1, 2)]
    fused = search.fuse_rankings([search.bm25(docs, asked), spark.createDataFrame([(7, 2, 1), (7, 5, 2)], "query_id long, id long, rank long")], 2)
    assert {r.id for r in fused.collect()} == {5, 1} or {r.id for r in fused.collect()} == {5, 2}
    assert search.bm25(docs.limit(0), asked).count() == 0


def test_diagram_and_pages(spark, tmp_path):
    rows = spark.createDataFrame([("w", "http", '/a"b', 1, "/r1/c.py", "/r2/s.py", "/r1", "/r2"), ("w", "topic", "t", 0, "/r1/c.py", "/x/d.py", "/r1", None)], "workspace string, kind string, key string, cross_repo int, client_path string, server_path string, client_root string, server_root string")
    text = render.diagram(rows, "w")
    assert text.startswith("flowchart LR\n") and 'n0 ==>|"http /a\'b"| n1' in text and 'n0 -->|"topic t"| n2' in text and 'subgraph external["external"]' in text
    assert render.diagram(rows, "none") == 'flowchart LR\n  empty["no connections found"]'
    path = render.write_document(tmp_path, "w", "My <Page>", "# H\n\n- a `x`\n\n```mermaid\nflowchart LR\n```\n\n|a|b|\n|-|-|\n|1|<2>|\n")
    page = path.read_text()
    assert "<h1>H</h1>" in page and '<div class="mermaid">\nflowchart LR\n</div>' in page and "<td>&lt;2&gt;</td>" in page and "My &lt;Page&gt;" in page and path.name.startswith("w-my-page-")


def test_doc_chunks(spark):
    rows = [(1, "/d/a.md", "pre\n# One\nx\r\n## Two ##\ny"), (2, "/d/b.txt", "no heads\n"), (3, "/d/c.md", None), (4, "/d/d.md", ""), (5, "/d/e.md", "  \n# H\nz"), (6, "/d/f.md", "INT. BARN - DAY\nq\nSECTION\nSECTION 2 x")]
    got = [(r.artifact_id, r.name, r.text) for r in files.doc_chunks(spark.createDataFrame(rows, "artifact_id long, path string, text string")).orderBy("artifact_id", "ord").collect()]
    assert got == [(1, "a.md", "pre\n"), (1, "One", "# One\nx\r\n"), (1, "Two ##", "## Two ##\ny"), (2, "b.txt", "no heads\n"), (4, "d.md", ""), (5, "H", "# H\nz"), (6, "INT. BARN - DAY", "INT. BARN - DAY\nq\nSECTION\n"), (6, "SECTION 2 x", "SECTION 2 x")]


def test_hybrid_search_fuses_full_ranks(spark):
    g = Graph(spark)
    texts = {**{i: "hay hay" for i in range(1, 5)}, 5: "hay in a long barn", **{i: "stone" for i in range(11, 15)}}
    chunks = spark.createDataFrame([(i, "w", 1, "section", "s", t) for i, t in texts.items()], "id long, workspace string, artifact_id long, kind string, name string, text string")
    chunks = g.with_tables(chunks=chunks)["chunks"]
    vectors = spark.createDataFrame([(5, [0.5, 1.0])] + [(i, [1.0, 0.0]) for i in range(11, 15)], "id long, vector array<double>")
    artifacts = g.with_tables(artifacts=spark.createDataFrame([(1, "w", "/a.md", "docs")], "id long, workspace string, path string, kind string"))["artifacts"]
    got = search.hybrid_search(chunks, artifacts, g["derived"], "hay", 1, "w", vectors, [1.0, 0.0]).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(5, round(2 / 65, 6))]


def test_hybrid_search_cites_pages(spark):
    g = Graph(spark)
    chunks = spark.createDataFrame([(1, "w", 1, "page", "p3", "hay"), (2, "w", 2, "section", "p4", "hay")], "id long, workspace string, artifact_id long, kind string, name string, text string")
    artifacts = spark.createDataFrame([(1, "w", "/a.pdf", "pdf"), (2, "w", "/b.md", "docs")], "id long, workspace string, path string, kind string")
    g = g.with_tables(chunks=chunks, artifacts=artifacts)
    for query in ("hay", "ha"):  # by rank, and by keyword
        got = search.hybrid_search(g["chunks"], g["artifacts"], g["derived"], query, 5, "w").collect()
        assert {(r.path, r.page) for r in got} == {("/a.pdf", 3), ("/b.md", None)}


@pytest.mark.parametrize("block", [512, 6, 2])
def test_cooccurrence_with_a_third_of_all_rows_in_one_chunk(spark, block):
    rng = random.Random(4)
    rows = [("w", 1, e) for e in range(60)] + [("w", rng.randrange(2, 40), rng.randrange(60)) for _ in range(120)] + [("v", 1, 1), ("v", 1, 2), ("w", 99, 1), ("w", 99, 2), ("w", 1, None), (None, 1, 5)]
    ch = spark.createDataFrame([(c, f"p{c}") for c in range(1, 40)] + [(1, None), (5, "p4")], "id long, name string")
    got = {(r.workspace, r.src_id, r.dst_id): (r.shared, r.first_page) for r in link.cooccurrence(spark.createDataFrame(rows, "workspace string, chunk_id long, entity_id long").withColumn("page", F.lit(1)), ch, block=block).collect()}
    want: dict = {}
    for w, c in {(w, c) for w, c, e in rows if w and c < 40}:
        items = sorted({e for x, y, e in rows if (x, y) == (w, c) and e is not None})
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                want.setdefault((w, a, b), []).append(c)
    assert got == {k: (len(v), 4 if min(v) == 5 else min(v)) for k, v in want.items() if len(v) > 1}


def test_ranks_of_large_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), k, rng.choice([1.0, 1.0, 2.0, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "q string, id long, score double")
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    got = {(r.q, r.id): r["rank"] for r in resolve.ranked(df, ["q"], order, 5).collect()}
    for q in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[(q, r[1])] for r in mine] == list(range(1, len(mine) + 1))
    assert resolve.ranked(df.limit(0), ["q"], order).count() == 0


def test_deep_pages(spark, monkeypatch):
    chunks_ = spark.createDataFrame([(k, "w" if k % 3 else "v", 1, "section", f"n{k}", "t", None, None) for k in range(60)], "id long, workspace string, artifact_id long, kind string, name string, text string, start_line int, end_line int")
    arts = spark.createDataFrame([(1, "w", "/a.md", "docs", None, None)], "id long, workspace string, path string, kind string, sha string, ingested_at timestamp")
    shallow = {tuple(r) for r in read.chunks_page(chunks_, arts, limit=5, offset=10).collect()}
    monkeypatch.setattr(read, "SHALLOW", 3)
    assert {tuple(r) for r in read.chunks_page(chunks_, arts, limit=5, offset=10).collect()} == shallow and len(shallow) == 10
    last = max(r.id for r in read.chunks_page(chunks_, arts, "w", limit=4).collect())
    assert {r.id for r in read.chunks_page(chunks_, arts, "w", limit=2, after=last).collect()} == {7, 8}
