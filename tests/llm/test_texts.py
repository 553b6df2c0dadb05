"""Code files, leakage, mixing and shared spans, against brute force where there is one."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import codefiles, leakage, mixing, spans

# ---- code files ----


@pytest.mark.parametrize(
    ("path", "lang", "why"),
    [
        ("/r/Vendor/x/a.go", "go", "vendored"), ("/r/internal/vendor/invoice.py", "python", None), ("src/external/client.py", "python", None), ("/r/external/zlib/a.c", "c", "vendored"), ("/r/src/external/zlib/a.c", "c", None), ("/r/lib/jquery.slim.js", None, "vendored"), ("/r/x/gen-py/a.py", None, "generated"), ("/r/x.pb.dart", None, "generated"), ("/r/a_pb2_grpc.pyi", None, "generated"), ("/r/static/js/2.chunk.f3a.js", None, "minified"), ("/r/models/sales_dataset.py", "python", None), ("/r/assets/sales_dataset.py", "python", "data"), ("C:\\r\\node_modules\\@a\\b\\i.js", None, "vendored"), ("/r/go/pkg/mod/x@v1.2.3/a.go", "go", "vendored"), ("/r/js/libs/x-1.2.3.js", "javascript", "vendored"),
        ("/r/api/a_pb2.py", "python", "generated"), ("/r/gen-src/A.java", "java", "generated"), ("/r/db/migrations/0007_auto_20240101_0102.py", "python", "generated"), ("/r/x/zz_generated.a.go", "go", "generated"), ("/r/package-lock.json", None, "generated"),
        ("/r/static/a.MIN.js", "javascript", "minified"), ("/r/x/a.17739a96.chunk.js", None, "minified"), ("/r/x/a-17739a96.js", None, "minified"), ("/r/data/a_blob.js", "text", "data"), ("/r/x/a.py", "CSV ", "data"), ("/r/assets/embedded_a_bytes.go", "go", "data"),
        ("/r/vendor_portal/a.py", "python", None), ("/r/x/generator_a.py", "python", None), ("/r/x/test_generated_a_ids.py", "python", None), ("/r/x/packed_a_reader.js", "javascript", None), ("/r/x/minimap_a.go", "go", None), ("/r/deps_graph/a.py", "python", None),
        ("/r/migrations/0001_initial.py", "python", None), ("/r/x/a.py", None, None), ("", "python", None), (None, "python", None), ("/r/x/notes.txt", "text", None), ("/r/x/feedfacedeed.js", "javascript", None),
    ],
)
def test_classify(path, lang, why):
    assert codefiles.classify(path, lang, codefiles.path_automaton()) == why


@pytest.mark.parametrize(
    ("head", "said"),
    [
        ("// Code generated by protoc-gen-go. DO NOT EDIT.", True), ("/*\n" + " * licence text\n" * 500 + " * @Generated\n */", True), ("# Generated by Django 4.2 on 2024-01-01", True), ("\n\n-- produced by sqlgen", True),
        ("# tests cover rows generated by the fixture", False), ('x = "do not edit"', False), ("İ" * 30 + "\n# AUTO-GENERATED", True), ("", False), (None, False), ("def do(): pass", False),
    ],
)
def test_notices(head, said):
    assert codefiles.has_notice(head, codefiles.notice_automaton()) == said


def test_not_hand_written(spark):
    rows = [(1, " CODE ", "/r/vendor/x/a.py", "python"), (1, "code", "/r/vendor/x/a.py", None), (2, "docs", "/r/vendor/x/a.md", "en"), (3, "code", "/r/a.py", "python"), (4, None, "/r/vendor/x/a.py", None), (None, "code", "/r/vendor/x/a.py", None), (5, "code", "/r/a.py", "python")]
    df = spark.createDataFrame(rows, "id long, kind string, path string, lang string").withColumn("reason", F.lit("x"))
    heads = spark.createDataFrame([(1, "# do not edit"), (2, "# do not edit"), (3, "# AUTO-GENERATED, do not edit"), (3, None), (5, "x"), (None, "# do not edit")], "artifact_id long, text string")
    assert {tuple(r) for r in codefiles.not_hand_written(df).collect()} == {(1, "vendored")}
    assert {tuple(r) for r in codefiles.not_hand_written(df, heads).collect()} == {(1, "vendored"), (3, "notice")}
    assert codefiles.not_hand_written(df.limit(0), heads).count() == 0


# ---- leakage ----


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for count in (1, 3, 8, 11):
        got = leakage.fingerprints(codes, count)
        for i, g in enumerate(got):
            bits = [sum(int(c) >> b & 1 for c in codes[i : i + count]) for b in range(64)]
            assert int(g) == sum(1 << b for b, k in enumerate(bits) if k > count // 2)


@pytest.mark.parametrize("radius", [3, 8, 13])
def test_near_finds_all_within_radius(radius):
    rng = random.Random(2)
    prints = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
    level = leakage.Level(30, radius, prints, np.arange(60), np.zeros(60, np.int64))
    asks = np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 3))) for p in prints for _ in range(5)], np.uint64)
    rows, windows = level.near(asks)
    want = {(i, j) for i, a in enumerate(asks) for j, p in enumerate(prints) if (int(a) ^ int(p)).bit_count() <= radius}
    assert set(zip(rows.tolist(), windows.tolist())) == want


def test_similarities_weigh_copies():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, (200, 14), dtype=np.uint64), rng.integers(0, 9, (200, 14), dtype=np.uint64)
    for x, y, s in zip(a, b, leakage.similarities(a, b)):
        both = sum(min((x == v).sum(), (y == v).sum()) for v in range(9))
        assert math.isclose(s, both / (28 - both))


def altered(words, edits, rng):
    """``words`` with ``edits`` words replaced, left out or put in, anywhere."""
    out = list(words)
    for _ in range(edits):
        k, how = rng.randrange(len(out)), rng.randrange(3)
        out[k : k + (how > 0)] = [f"x{rng.randrange(10**6)}"] if how < 2 else []
    return out


@pytest.mark.parametrize(("shingle", "least"), [(5, 0.8), (1, 0.7)])
def test_recall_of_altered_passages(spark, shingle, least):
    """Against brute force over all windows of all items: at least 0.9 of what reaches the similarity is found."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(600)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randrange(12, 61))]) for k in range(60)]
    docs, planted = [], {}
    for d in range(400):
        k, ws = rng.choice(items)
        inside = altered(ws, d % 4, rng)
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + inside + [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        docs.append((d, text))
        planted[d] = (k, d % 4)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    it = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, it, shingle=shingle, least=least).collect()}

    sizes = leakage.ladder(12, 60)
    bag = lambda ws: [tuple(ws[k : k + shingle]) for k in range(len(ws) - shingle + 1)]
    rows = lambda ws, n: np.array([[hash(x) for x in bag(ws[k : k + n])] for k in range(len(ws) - n + 1)], np.int64).astype(np.uint64)
    want = set()
    for d, text in docs:
        k, _ = planted[d]
        ws = dict(items)[k]
        for n in (12, max(s for s in sizes if s <= len(ws))):
            a, b = rows(text, n), rows(ws, n)
            if len(a) and len(b) and leakage.similarities(np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1))).max() >= least:
                want.add((d, k))
    assert len(got & want) >= 0.9 * len(want)
    if shingle == 1:  # planted edits of 1 to 3 words in items of 12 to 60
        for edits in (1, 2, 3):
            some = [(d, k) for d, (k, e) in planted.items() if e == edits]
            assert len(got & set(some)) >= 0.9 * len(some), edits


def brute_leaks(docs, items):
    found = set()
    for d, t in docs:
        ws = [w.lower() for w in leakage._WORD.findall(t or "")]
        runs = {tuple(ws[k : k + 12]) for k in range(len(ws) - 11)}
        for i, s in items:
            us = [w.lower() for w in leakage._WORD.findall(s or "")]
            if any(tuple(us[k : k + 12]) in runs for k in range(len(us) - 11)):
                found.add((d, i))
    return found


@pytest.mark.parametrize("item_windows", [1_000_000, 30])
def test_leaks(spark, item_windows):
    rng = random.Random(3)
    word = lambda: rng.choice(["été", "Fox", "run_it", "x1", "Straße", "lamp", "moor", "tin", "oak", "ÉTÉ", "σοφός"])
    items = [(k, " ".join(word() for _ in range(rng.randrange(5, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            src = rng.choice(items[:12])[1].split()
            a = rng.randrange(len(src))
            text[5:5] = [w.upper() for w in src[a : a + rng.choice([8, 11, 12, 13, 30])]]
        docs.append((d, ", ".join(text)))
    docs += [(900, None), (901, ""), (902, (items[0][1] + " ") * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = leakage.leaks(df, it, item_windows=item_windows)
    assert {(r.doc_id, r.item_id) for r in got.where("run_words >= 12").collect()} == brute_leaks(docs, items)
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


# ---- mixing ----


def test_weights():
    w, x = mixing.temperature_weights({"a": 900, "b": 90, "c": 10, "d": 0}, 0.9)
    assert set(w) == {"a", "b", "c"} and math.isclose(mixing.entropy(w), 0.9, abs_tol=1e-6) and 0 < x < 1
    w, x, total = mixing.capped_weights({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5, "gone": 0.2}, {"a": 1, "b": 3, "gone": 2})
    assert w == {"a": 0.5, "b": 0.5} and x == 0 and math.isclose(total, 60)
    w, x, total = mixing.capped_weights({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 100)
    assert 0 < x < 1 and math.isclose(w["b"] * total, 30, rel_tol=1e-6) and math.isclose(w["a"], 0.7, rel_tol=1e-6)
    assert mixing.capped_weights({"a": 100}, {"a": 1.0}, {"a": 2}, 1e9)[2] == 200
    assert mixing.capped_weights({}, {"a": 1.0}, {"a": 2})[0] == {}


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([" Alpha", "alpha", "beta-x", "Beta X", None, "gamma"]), "word " * rng.randrange(1, 80)) for i in range(600)] + [(1000, "alpha", ""), (1001, "alpha", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("alpha", 0.5, 2), ("beta_x", 0.3, 1), ("absent", 0.1, 4), ("gamma", 0.1, 3)], "source string, target_share double, max_repeats int")
    sizes = mixing.token_sizes(df)
    got = mixing.mix(sizes, targets)
    rows = {r.doc_id: r for r in got.collect()}
    assert all(1 <= r.copies <= {"alpha": 2, "beta_x": 1, "gamma": 3}[r.source] for r in rows.values())
    again = {r.doc_id: r.copies for r in mixing.mix(sizes.repartition(7), targets).collect()}
    assert again == {d: r.copies for d, r in rows.items()}
    said = {r.source: r for r in mixing.shares(got, sizes, targets).collect()}
    for s, q in (("alpha", 0.5 / 0.9), ("beta_x", 0.3 / 0.9), ("gamma", 0.1 / 0.9)):
        assert abs(said[s].reached_share - q) < 0.02
    assert said["absent"].tokens == 0 and said["unknown"].tokens == 0
    assert mixing.mix(mixing.token_sizes(df.limit(0)), targets).count() == 0
    capped = mixing.mix(sizes, targets, budget=1e9)
    assert capped.where("source = 'alpha'").agg(F.min("copies")).first()[0] == 2


@pytest.mark.parametrize(("bits", "docs_"), [(12, 4096), (2, 5), (1, 1)])
def test_blocks_of_any_size_cut_at_the_same_place(spark, monkeypatch, bits, docs_):
    """The cut is that of the whole permutation, however it is divided into blocks."""
    monkeypatch.setattr(mixing, "BLOCK_BITS", bits if 60 % bits == 0 else 12)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", docs_)
    rng = random.Random(11)
    docs = [(i, rng.choice("ab"), rng.randrange(1, 50)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("rank", F.shiftrightunsigned(F.xxhash64(F.lit(1), "doc_id"), 4)).persist()
    rests = {"a": 777.0, "b": 0.5}
    ends = {s: (r, d) for s, r, d in mixing._ends(df, rests)}
    for s, rest in rests.items():
        run, want = 0, set()
        for r in sorted((r.rank, r.doc_id, r.tokens) for r in df.where(F.col("source") == s).collect()):
            run += r[2]
            want |= {r[1]} if run <= rest else set()
        assert want == {r.doc_id for r in df.where(F.col("source") == s).collect() if (r.rank, r.doc_id) <= ends[s]}
    assert mixing._ends(df, {"a": 1e9}) == [("a", 1 << 60, 0)]


def test_tempered_mix(spark, tmp_path):
    from weftgraph.llm import queries

    docs = [(i, "big" if i % 20 else "scarce", "word " * (20 + i % 30)) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.5, 3), ("scarce", 0.5, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    exact, near = ({r.source: r for r in queries.queries()[q](spark, str(tmp_path)).collect()} for q in ("p9_exact_shares", "p9_shares"))
    every = mixing.token_sizes(spark.read.parquet(str(tmp_path / "documents.parquet"))).agg(F.sum("tokens")).first()[0]
    assert abs(exact["scarce"].reached_share - 0.5) < 0.02 and sum(r.tokens for r in exact.values()) < 0.25 * every
    assert 0.95 * every < sum(r.tokens for r in near.values()) <= every
    assert exact["big"].exponent == 0 and 0 < near["big"].exponent < 1
    # the scarce source gives all that it may, and so do the documents selected
    assert near["scarce"].most_copies == 2 and near["scarce"].planned_share < 0.15 and abs(near["scarce"].reached_share - near["scarce"].planned_share) < 0.02
    rows = queries.queries()["p9_selection"](spark, str(tmp_path)).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()
    assert {r.source: r.n for r in rows} == {s: r.tokens for s, r in near.items()}


# ---- shared spans ----


def brute_spans(docs, least=300):
    seen: dict[str, set] = {}
    for d, t in docs:
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(d)
    return {(a, b) for ds in seen.values() for a in ds for b in ds if a < b}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdef ghé\n😀") for _ in range(n))
    shared = [text(n) for n in (299, 300, 301, 420, 1500)]
    docs = [(i, text(rng.randrange(1200))) for i in range(40)]
    for i in range(40, 100):
        s = rng.choice(shared)
        docs.append((i, text(rng.randrange(200)) + s + text(rng.randrange(200))))
    docs += [(200, "-" * 5000), (201, "-" * 320), (202, "-" * 299), (203, None), (204, ""), (205, "ab" * 400), (206, "ba" * 300), (207, docs[0][1]), (208, shared[4] * 4)]
    return docs


@pytest.mark.parametrize("group", [48, 3])
def test_shared_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(spans, "GROUP", group)
    docs = corpus(6)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(3)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == brute_spans(docs)


@pytest.mark.parametrize("group", [48, 3])
def test_coverage(spark, monkeypatch, group):
    monkeypatch.setattr(spans, "GROUP", group)
    docs = [(d, t) for d, t in corpus(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1))
    seen: dict[str, set] = {}
    for d, t in docs:
        for k in range(len(t or "") - 299):
            seen.setdefault(t[k : k + 300], set()).add(d)
    want = {}
    for d, t in docs:
        hit = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - 299):
            if len(seen[t[k : k + 300]]) > 1:
                hit[k : k + 300] = True
        want[d] = int(hit.sum())
    rows = {r.doc_id: r for r in spans.coverage(df).collect()}
    assert {d: r.shared_chars for d, r in rows.items()} == want
    assert rows[207].class_id == rows[0].class_id == (0 if len(docs[0][1]) >= 300 else None)
    found = spans.passages(df).collect()
    assert sum(r.length for r in found) == sum(want.values()) and all(r.length >= 300 for r in found)


def test_a_third_are_copies(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdef ghé") for _ in range(n))
    copy = text(900)
    docs = [(i, copy if i % 3 == 0 else text(400)) for i in range(300)] + [(1000, copy[100:500])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == brute_spans(docs)
    rows = {r.doc_id: r.shared_chars for r in spans.coverage(df).collect()}
    assert rows[0] == 900 and rows[1000] == 400 and rows[1] == 0


def test_shared_pairs_empty(spark):
    df = spark.createDataFrame([(1, "a" * 500)], "doc_id long, text string")
    assert spans.shared_pairs(df).count() == 0 and spans.shared_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spans.shared_pairs(df, 200)


def test_cuts_do_not_shift():
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    a = set(spans.chunk_digests([base])[3].tolist())
    b = set(spans.chunk_digests(["inserted text, " + base[:2000] + "!" + base[2000:]])[3].tolist())
    assert len(a & b) > 0.85 * len(a)
