"""The engine object and the command line, end to end."""

from __future__ import annotations

import json

from weftgraph.__main__ import parser, run
from weftgraph.api import Engine


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "b").mkdir()
    (src / "a/client.py").write_text('def call():\n    return requests.get("http://h/pens/{n}")\n\ndef other():\n    client.post("/lost/one")\n')
    (src / "b/server.py").write_text('@app.get("/pens/<id>")\ndef pens():\n    pass\n')
    (src / "b/readme.md").write_text("# Pens\nThe `pens` endpoint keeps harbour gates.\n")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.create_workspace("w") == {"workspace": "w", "created": True} and e.create_workspace("w")["created"] is False
    e.set_intent("w", "what calls what")
    e.ingest(str(src / "a"), "w")
    counts = e.ingest(str(src / "b"), "w")
    assert (counts["code"], counts["docs"], counts["structural_bindings"], counts["cross_source_edges"]) == (1, 1, 1, 1)
    said = e.overview("w")
    assert (said["intent"], said["structural_bindings"], said["cross_repo_bindings"]) == ("what calls what", 1, 1) and e.overview("none") is None
    assert e.list_workspaces().first().artifacts == 3 and e.list_artifacts("w").count() == 3
    assert "==>" in e.export_graph("w") and "empty" in e.export_graph("none")
    assert [(r.role, r.key) for r in e.binding_candidates("w").collect()] == [("client", "/lost/one")]
    hit = e.search("w", "harbour gates").collect()
    assert hit[0].name == "Pens" and hit[0].retriever == "hybrid"
    assert [r.retriever for r in e.search("w", "arbou").collect()] == ["keyword"] and e.search("w", "zzz").count() == 0
    assert e.cross_edges("w", "pens").count() == 1 and e.neighbors("w", "pens").count() == 1
    page = e.chunks("w", limit=1).first()
    assert e.get_chunk("w", page.id)["id"] == page.id and e.get_chunk("w", -5) is None
    assert e.add_entity("w", "Old Pier", "place", {"page": 3}, [page.id])["ok"] and e.add_relation("w", "Old Pier", "pens", "near", asserted=False)["ok"]
    assert e.add_relation("w", "Old Pier", "Nowhere", "near") == {"ok": False, "error": "entity not found: Nowhere"}
    e.add_entity("w", "the old pier", "place")
    assert e.resolve_entities("w", "place") == {"merged_entities": 1}
    assert {r.name for r in e.entities("w", "place").collect()} == {"Old Pier"}
    assert e.merge_entities("w", "Nobody", ["x"])["ok"] is False and e.merge_entities("w", "Old Pier", ["call"])["merged"] == 1
    args = parser().parse_args(["--store", str(tmp_path / "store"), "edges", "w", "pens", "--min-confidence", "0.9"])
    assert run(e, args).count() == 0
    assert json.loads(run(e, parser().parse_args(["--store", "x", "artifacts", "w"])).toJSON().first())["workspace"] == "w"


def test_derived_pages_are_cited_by_their_original(spark):
    from weftgraph.operators import read

    hits = spark.createDataFrame([(1, "/d/p1.md"), (2, "/x.md"), (3, None)], "id long, path string")
    derived = spark.createDataFrame([("w", "/d/p1.md", "/b.pdf", 1)], "workspace string, derived_path string, orig_path string, page int")
    assert {(r.id, r.path, r.page) for r in read.original_place(hits, derived).collect()} == {(1, "/b.pdf", 1), (2, "/x.md", None), (3, None, None)}


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftgraph.streaming import events

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in/events.parquet"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/events.parquet"))
    got = {(r.window_start, r.n) for r in events.drain(events.window_counts(stream)).collect()}
    assert got == {(r.window_start, r.n) for r in events.window_counts(rows).collect()} and len(got) == 4
    seen: list[int] = []
    for _ in range(2):
        events.process_new_files(spark, str(tmp_path / "in/events.parquet"), rows.schema, lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    assert sum(seen) == 200
