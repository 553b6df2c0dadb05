"""Variant spellings: the join against brute force, the parser, and the groups."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftgraph.llm import names as n


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_osa():
    assert n.osa("abcd", "abdc", 1) == 1 and n.osa("abcd", "abd", 1) == 1 and n.osa("abcd", "axcd", 2) == 1
    assert n.osa("abcd", "dcba", 2) == 3 and n.osa("", "abc", 2) == 3 and n.osa("same", "same", 0) == 0
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(7)))
        assert n.osa(a, b, 2) <= min(3, lev(a, b))


def test_slip_pairs_are_complete(spark):
    rng = random.Random(2)
    keys = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(220)} | {"a" * 30, "a" * 28 + "ba", "a" * 28 + "ab", "a" * 29}
    rows = [(h, k, 1) for h in ("x", "y") for k in keys] + [("x", "", 1), ("x", None, 1), (None, "abc", 1)]
    df = spark.createDataFrame(rows, "head string, key string, other int")
    for again in (True, False):
        probes = df.select("head", F.col("key").alias("probe"), F.lit(again).alias("again"), F.col("head").alias("h"))
        got = {(r.h, r.key, r.probe): r.distance for r in n.slip_pairs(df, probes).collect()}
        want = {(h, x, y): n.osa(x, y, 1) for h in ("x", "y") for x in keys for y in keys if n.osa(x, y, 1) <= 1 and (not again or len(x) >= len(y))}
        assert got == want
    assert n.slip_pairs(df.limit(0), probes).count() == 0


def test_parser():
    assert n.parse_person("Dr. Vane, Robert T.")[0]["surname"] == "drvane" or n.parse_person("Dr. Robert Vane")[0]["surname"] == "vane"
    assert n.parse_person("VANE, Robert T.") == [{"form": "full", "given": "robert", "surname": "vane", "initials": "t", "alt": "", "maybe": ""}]
    assert n.parse_person("Bob Vane")[0]["given"] == "robert" and n.parse_person("Pat Vane")[0]["given"] == "pat"
    assert n.parse_person("Pat Vane")[0]["maybe"] == "patricia vane\npatrick vane"
    assert n.parse_person("R. T. Vane")[0]["initials"] == "rt" and n.parse_person("R.T. Vane")[0]["form"] == "short"
    assert n.parse_person("Vane")[0]["form"] == "short" and n.parse_person("...") == [] and n.parse_person("") == []
    a, b = n.parse_org("The Alder Sluice Engg Co.")[0], n.parse_org("Alder Sluice Engineering Company")[0]
    assert a == b and a["given"] == "engineering" and a["surname"] == "alder sluice"
    assert n.parse_org("Engineering, Alder Sluice")[0]["surname"] == "alder sluice"
    assert n.parse_org("ASE (Alder)")[0]["initials"] == "ase" and n.parse_org("Alder S.E.")[0]["form"] == "short"
    assert n.is_org("Alder & Sons") and not n.is_org("Robert Vane")


def groups(spark, rows):
    out: dict = {}
    for r in n.name_groups(spark.createDataFrame(rows, "id long, workspace string, name string, etype string, props string")).collect():
        out.setdefault(r.group_id, set()).add(r.entity_id)
    return sorted(map(sorted, out.values()))


def test_groups(spark):
    rows = [
        (1, "w", "Robert Vaneholt", "person", "p"),
        (1, "w", "Robert Vaneholt", "person", "p"),
        (2, "w", "VANEHOLT, Bob", "Person ", None),
        (3, "w", "Robert Vanehlot", "character", None),
        (4, "w", "R. Vaneholt", "party", None),
        (5, "w", "Susan Vaneholt", "person", None),
        (6, "v", "Robert Vaneholt", "person", None),
        (7, "w", "Robert Vaneholt", "location", None),
        (8, "w", "Robert Vaneholt", None, None),
        (9, "w", "...", "person", None),
        (10, "w", None, "person", None),
        (11, "w", "Aldermoor Sluice Engineering Company", "org", None),
        (12, "w", "Aldermoor Sluice & Engg. Co", "company", None),
        (13, "w", "Engineering, Aldermoor Sluice", "organisation", None),
        (14, "w", "ASE (Aldermoor)", "party", None),
        (15, "w", "Aldermoor Sluice Trading Company", "org", None),
        (16, "w", "Vaneholt", "person", None),
        (17, "w", "Róbert  Vaneholt ", "person", None),
        (18, "w", "Aldermoor S.E.", "party", None),
    ]
    assert groups(spark, rows) == [[1, 2, 3, 4, 17], [11, 12, 13, 14, 18]]
    assert groups(spark, []) == []


def people(*names, etype="person"):
    return [(i, "w", x, etype, None) for i, x in enumerate(names, 1)]


def test_nicknames_of_several_names_join_nobody_by_themselves(spark):
    assert groups(spark, people("Patrick Vane", "Patricia Vane", "Pat Vane")) == []
    assert groups(spark, people("Christopher Vane", "Christina Vane", "Chris Vane", "Vane, Chris")) == [[3, 4]]
    assert groups(spark, people("Patricia Vane", "Pat Vane", "Vane Pat")) == [[1, 2, 3]]
    assert groups(spark, people("Patty Vaneholt", "Patricia Vaneholt", "Pat Vanehlot", "P. Vaneholt")) == [[1, 2, 3, 4]]
    assert groups(spark, people("Jo Vane", "Joseph Vane", "Josephine Vane", "Kate Vane", "Katherine Vane")) == [[4, 5]]


def test_names_that_both_occur_often_are_two(spark):
    often = [f"{g} {s}" for g in ("Joan", "John") for s in ("Aldmoor", "Bexvale", "Corwick", "Dunfold", "Elmstow")]
    assert groups(spark, people(*often, "Jonh Aldmoor")) == [[6, 11]]


def test_words_shortened_by_rule(spark):
    rows = people("Acme Quarry Works", "Acme Quarry Wks", "Norton Freight", "Norton Frt.", "Norton Foundry", "Zed Marine Haulage", "Zed Marine H", "Ober Stone", "Ober Stein", "Ober St", etype="org")
    assert groups(spark, rows) == [[1, 2], [3, 4]]


def test_recall_on_names_outside_the_lists(spark):
    """Made-up given names, surnames and trades, each with typed variants; slips, order, case, titles, initials and shortened words."""
    rng = random.Random(7)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "l", "n", "r", "s", "x"])
    made = lambda k: "".join(syllable() for _ in range(k)).capitalize()

    def slip(t):
        k = rng.randrange(1, len(t) - 1)
        return rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice("aeiou") + t[k:], t[:k] + t[k + 1] + t[k] + t[k + 2 :], t[:k] + rng.choice("bdklmn") + t[k + 1 :]])

    rows, truth = [], {}
    for k in range(400):
        if k % 2:
            g, f = made(2) + "o", made(3) + "el"
            forms = [f"{g} {f}", f"{f}, {g}", f"{f} {g}", f"Dr. {g.upper()} {f.upper()}", f"{g} {slip(f)}", f"{slip(g)} {f}", f"{g} X. {f}", f"{g[0]}. {f}"]
        else:
            a, b = made(3), rng.choice(["Quarries", "Freight", "Bakery", "Printworks", "Textiles", "Garments"])
            bare = b[0] + "".join(c for c in b[1:] if c not in "aeiou")
            forms = [f"{a} {b}", f"{a.upper()} {b.upper()}", f"The {a} {b}", f"{a} {b} Ltd", f"{slip(a)} {b}", f"{a} {bare[:5]}.", f"{a} {b[:4]}."]
        for form in rng.sample(forms, 4):
            rows.append((len(rows), f"w{k % 5}", form, "person" if k % 2 else "company", None))
            truth[len(rows) - 1] = k
    got = {(r.entity_id_a, r.entity_id_b) for r in n.name_pairs(spark.createDataFrame(rows, "id long, workspace string, name string, etype string, props string")).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.99 * len(got), (len(got), len(want), len(got & want))


def test_copies_and_pairs(spark):
    rows = [(i, "w", "Klara Orbrand", "person", None) for i in range(1, 41)] + [(99, "w", "Klara Orbrnad", "person", None)]
    df = spark.createDataFrame(rows, "id long, workspace string, name string, etype string, props string")
    assert n.name_pairs(df).count() == 41 * 40 // 2
