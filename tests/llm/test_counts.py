"""Terms, baskets and components against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import baskets, components, terms

MENTION = "id long, workspace string, entity_id long, chunk_id long, surface string, extra string"
ENTITY = "id long, workspace string, name string, etype string, props string"


def table(spark, mentions, entities, shared=()):
    out = terms.term_table(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(shared), "id long, name string, etype string"))
    return {(r.workspace, r.field_name, r.term): (r.occurrences, r.records, r.total, r.mark) for r in out.collect()}


def test_terms(spark):
    entities = [
        (2, "w", "  Red\u00a0 Door ", "t", '{"tags": ["A", " b  c", 3, null, ""]}'),
        (2, "w", "  Red\u00a0 Door ", "t", '{"tags": ["A", " b  c", 3, null, ""]}'),
        (3, "w", "RED DOOR", "t", '{"tags": "a"}'),
        (4, "v", "blue", None, '{"tags": ["a"'),
        (5, "w", "", "t", "[]"),
        (6, "w", None, "t", None),
    ]
    mentions = [(i, "w", 2, i, None, "x") for i in range(1, 4)] + [(1, "w", 2, 1, None, "x"), (10, "w", 3, 1, "s", "x"), (11, "v", 2, 7, None, "x"), (12, "w", 77, 8, None, "x"), (13, "w", None, 9, None, "x"), (14, "w", 5, 9, None, "x"), (15, "w", 1, None, None, "x"), (16, None, 2, 1, None, "x"), (17, "w", 1, 9, None, "x")]
    got = table(spark, mentions, entities, [(1, "Shared One", "t")])
    assert got == {
        ("w", "name", "red door"): (4, 3, 5, "common"), ("v", "name", "red door"): (1, 1, 1, "rare"), ("w", "name", "shared one"): (1, 1, 5, "rare"),
        ("w", "tag", "a"): (2, 2, 4, "common"), ("w", "tag", "b c"): (1, 1, 4, "rare"),
    }
    assert table(spark, [], []) == {}


def test_terms_random(spark, monkeypatch):
    monkeypatch.setattr(terms, "CELLS", 20)
    rng = random.Random(3)
    entities = [(i, "w", f"name {i % 17}", "t", None) for i in range(60)]
    mentions = [(k, rng.choice("wv"), 0 if rng.random() < 0.4 else rng.randrange(70), rng.randrange(40), None, "x") for k in range(900)]
    got = table(spark, mentions, entities)
    occ, rec = Counter(), defaultdict(set)
    for _, w, e, c, _, _ in mentions:
        if e < 60:
            occ[(w, f"name {e % 17}")] += 1
            rec[(w, f"name {e % 17}")].add(c)
    assert {k: v[:2] for k, v in got.items()} == {(w, "name", t): (n, len(rec[(w, t)])) for (w, t), n in occ.items()}


def brute_pairs(rows, min_count, min_lift):
    by = defaultdict(lambda: defaultdict(set))
    for s, b, i in rows:
        if None not in (s, b, i):
            by[s][b].add(i)
    out = set()
    for s, bs in by.items():
        one, two = Counter(), Counter()
        for items in bs.values():
            one.update(items)
            two.update(itertools.combinations(sorted(items), 2))
        out |= {(s, a, b, n, one[a], one[b], len(bs)) for (a, b), n in two.items() if n >= min_count and n * len(bs) >= min_lift * one[a] * one[b]}
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_baskets(spark, block):
    rng = random.Random(4)
    rows = [(rng.choice("uv"), rng.randrange(60), min(rng.randrange(1, 40), rng.randrange(1, 40))) for _ in range(900)]
    rows += [("u", b, i) for b in range(100, 106) for i in range(200, 212)] + rows[:50] + [(None, 1, 1), ("u", None, 1), ("u", 1, None)]
    df = spark.createDataFrame(rows, "scope string, basket long, item long")
    for min_count, min_lift in ((2, 1), (5, 8), (3, 2)):
        got = {tuple(r) for r in baskets.frequent_pairs(df, min_count, min_lift, block).select("scope", "a", "b", "n_ab", "n_a", "n_b", "n").collect()}
        assert got == brute_pairs(rows, min_count, min_lift)
    assert baskets.frequent_pairs(df.limit(0)).count() == 0


def test_one_basket_holds_a_third(spark):
    rng = random.Random(6)
    rows = [("u", b, rng.randrange(400)) for b in range(200) for _ in range(4)] + [("u", b, i) for b in range(300, 306) for i in range(0, 30)]
    rows += [("u", 1000, i) for i in range(400)] + [("v", 1, i) for i in range(400)]
    df = spark.createDataFrame(rows, "scope string, basket long, item long")
    for min_count in (2, 5):
        got = {tuple(r) for r in baskets.frequent_pairs(df, min_count, 1, 40).select("scope", "a", "b", "n_ab", "n_a", "n_b", "n").collect()}
        assert got == brute_pairs(rows, min_count, 1)


def brute_groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("bound", [2_000_000, 40])
def test_components(spark, bound):
    rng = random.Random(5)
    chain = list(range(1000, 1120))
    rng.shuffle(chain)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + list(zip(chain, chain[1:])) + [(5000, 5000 + i) for i in range(90)] + [(1, None), (None, 2), (7, 7), (None, None), (9000, 9001), (9001, 9000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {tuple(r) for r in components.components(df, bound).collect()} == brute_groups(edges)
    assert components.components(df.limit(0), bound).count() == 0
