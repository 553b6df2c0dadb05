"""Variant spellings of the names of persons and organisations.

1. Names are parsed: titles, legal forms, articles and connectors fall away, accents and
   case too; a nickname of one given name only stands for that; parts get an order.  What
   is left is a key of two parts (given name and surname, or what an organisation does and
   its own words), and copies of a key count once from here on.
2. Pigeonhole join for one slip (``k = 1``): a name that is one slip off another has one of
   its two parts unchanged.  The other part is cut into ``k + 1`` segments, of which the
   slip leaves one unchanged, shifted by at most one; a letter between the segments belongs to
   neither, so that swapped neighbours do not break both.  Segments go into an inverted index under their
   part, the substrings of the possible lengths and shifts are looked up there, and what
   meets is verified by a banded edit distance.
3. Linked keys form groups.  What is not sure by itself joins a group only if exactly one
   of its workspace fits: a nickname of several given names, an unknown given name close to a nickname,
   a word shortened by rule, and short forms (an initial, a surname alone, initials of an organisation).

Nothing compares all names of a block with each other; a key with a third of all rows is
one row after step 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.components import components
from weftgraph.plans.durable import durable, kept

#: Labels of persons, of organisations, and of either (lower case).
PERSON_TYPES = {"person", "character", "people", "human", "per"}
ORG_TYPES = {"org", "organisation", "organization", "company", "firm", "institution", "corporation"}
EITHER_TYPES = {"party"}

TITLES = set("dr prof professor capt captain judge justice mr mrs ms miss mx sir dame lord lady rev reverend hon lt col gen sgt maj major sen rep pres st fr sr jr ii iii iv phd md esq".split())
CONNECTORS = {"and", "und", "et", "y", "the", "of"}

#: Legal forms with what stands for them.
LEGAL = {
    "incorporated": "inc incorp",
    "corporation": "corp corpn",
    "company": "co coy",
    "limited": "ltd lim",
    "holdings": "hldg hldgs holding",
    "gmbh": "gesmbh",
    "llc": "",
    "llp": "",
    "plc": "",
    "ag": "",
    "sa": "",
    "bv": "",
    "group": "grp",
}
#: Words for what an organisation does, with usual abbreviations.
SECTORS = {
    "trading": "trad trdg",
    "logistics": "log logist logis lgstcs",
    "associates": "assoc assocs assc",
    "insurance": "ins insur insce",
    "international": "intl internatl inter int",
    "brothers": "bros bro",
    "technologies": "tech techs technol technology",
    "laboratories": "lab labs laboratory",
    "manufacturing": "mfg manuf mfrg",
    "services": "svc svcs serv service",
    "engineering": "eng engg engr engrg",
    "shipping": "ship shpg shipg",
    "partners": "ptnrs",
    "industries": "ind inds",
    "systems": "sys",
    "solutions": "soln solns",
    "consulting": "cons consult",
}
#: Given names and what people say for them.
NICKNAMES = {
    "abigail": "abby gail abbie",
    "alexander": "alex sandy xander alec sasha",
    "andrew": "andy drew",
    "anthony": "tony ant",
    "barbara": "babs barb barbie",
    "benjamin": "ben benny benji",
    "catherine": "cathy kate katie cath",
    "charles": "charlie chuck chas",
    "christina": "tina chris chrissy christy",
    "christopher": "chris kit topher",
    "cynthia": "cindy cyn",
    "daniel": "dan danny",
    "david": "dave davey",
    "deborah": "deb debbie debby",
    "dorothy": "dot dottie dolly dory",
    "edward": "ted ed eddie ned teddy eddy",
    "eleanor": "nell ellie nora nellie ella",
    "elizabeth": "liz beth betty lizzie eliza libby bess betsy",
    "frederick": "fred freddie freddy",
    "gabriel": "gabe",
    "george": "geo",
    "gregory": "greg",
    "harold": "hal harry",
    "henry": "hank harry",
    "hector": "heck",
    "irene": "rena",
    "jacob": "jake",
    "james": "jim jimmy jamie",
    "jennifer": "jen jenny jenn",
    "john": "jack johnny jon",
    "joseph": "joe joey jo",
    "josephine": "jo josie",
    "katherine": "kate kathy katie kath kay kitty",
    "lawrence": "larry laurie",
    "leonard": "len lenny leo",
    "margaret": "maggie meg peggy marge greta margie",
    "matthew": "matt matty",
    "michael": "mike mick mickey micky",
    "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky",
    "patricia": "pat patty trish tricia",
    "patrick": "pat paddy",
    "penelope": "penny",
    "peter": "pete",
    "philip": "phil pip",
    "raymond": "ray",
    "rebecca": "becky becca",
    "richard": "rick dick rich ricky richie",
    "robert": "bob rob bobby robbie bert",
    "samuel": "sam sammy",
    "stephen": "steve steph",
    "susan": "sue susie suzy",
    "theodore": "ted theo teddy",
    "thomas": "tom tommy",
    "timothy": "tim timmy",
    "victoria": "vicky tori vick vicki",
    "viola": "vi",
    "virginia": "ginny ginger",
    "walter": "walt wally",
    "william": "bill will billy willy liam",
}

#: Forms of a given name from which on it counts as one that people have, and how many times rarer a slip of it is.
OFTEN, MUCH = 3, 10

_FORMAL: dict[str, set[str]] = {}
for _name, _short in NICKNAMES.items():
    _FORMAL.setdefault(_name, set()).add(_name)
    for _s in _short.split():
        _FORMAL.setdefault(_s, set()).add(_name)
_LEGAL = {a: full for full, short in LEGAL.items() for a in [full, *short.split()]}
_SECTOR = {a: full for full, short in SECTORS.items() for a in [full, *short.split()]}
#: Initials of an organisation with one of its words, as in ``ABC (Alpha)``.
_ACRONYM = re.compile(r"\A([A-Z]{2,6}) *\(([^\W\d_]{3,})\)\Z")


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or ``most + 1`` if it takes more.

    Only the band of ``2 * most + 1`` diagonals is computed.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, far)
        if min(new) > most:
            return far
        before, row = row, new
    return row[-1]


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@lru_cache(100_000)
def formal(given: str) -> tuple[str, tuple[str, ...]]:
    """The given name that ``given`` stands for, and those it may stand for too.

    A given name stands for itself, a nickname of one given name for that.  A nickname of
    several, and a word one slip off longer nicknames, stand for themselves and may stand for those.
    """
    if given in NICKNAMES:
        return given, ()
    if given in _FORMAL:
        names = tuple(sorted(_FORMAL[given]))
        return (names[0], ()) if len(names) == 1 else (given, names)
    near = {f for n, fs in _FORMAL.items() if len(n) >= 4 and n not in NICKNAMES and osa(n, given, 1) <= 1 for f in fs} if len(given) >= 4 else set()
    return given, tuple(sorted(near))


@lru_cache(100_000)
def _word(token: str, table: str) -> str | None:
    """What a word of an organisation's name stands for: exactly, or with one slip in a long word."""
    words = _LEGAL if table == "legal" else _SECTOR
    if token in words:
        return words[token]
    if len(token) >= 4:  # cut off
        begun = [full for full in (LEGAL if table == "legal" else SECTORS) if full.startswith(token)]
        if len(begun) == 1:
            return begun[0]
    if len(token) >= 6:
        for full in LEGAL if table == "legal" else SECTORS:
            if len(full) >= 7 and osa(token, full, 1) <= 1:
                return full
    return None


def _tokens(text: str) -> list[str]:
    text = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", re.sub(r"\b(\w)\.(?:(\w)\.)+", lambda m: m.group(0).replace(".", "") + " ", text))
    return [t for t in re.split(r"[^\w']+", text.replace("_", " ").replace("'", "")) if t]


def _reading(form: str, given: str, surname: str, initials: str, alt: str = "", maybe: str = "") -> dict:
    return {"form": form, "given": given, "surname": surname, "initials": initials, "alt": alt, "maybe": maybe}


def parse_person(name: str) -> list[dict]:
    """The reading of a person's name, if any: full (given and surname) or short (surname, perhaps with initials).

    ``alt`` is the reading in turned order, ``maybe`` lists readings that are not sure, as lines of given and surname.
    """
    text = plain(name).replace("_", " ")
    head, comma, tail = text.partition(",")
    if comma and not [t for t in _tokens(tail) if t not in TITLES]:
        text, comma = head, ""
    surname_first = [t for t in _tokens(head) if t not in TITLES] if comma else []
    tokens = [t for t in _tokens(tail if comma else text) if t not in TITLES]
    raw = set(re.findall(r"\b(?:\w\.)+(?:\w\b)?", text))
    dotted = {r.replace(".", "") for r in raw}
    short = lambda t: len(t) == 1 or (len(t) <= 3 and t in dotted)
    long_ = [t for t in tokens if not short(t)]
    letters = "".join(t for t in tokens if short(t))
    surname = "".join(surname_first) if comma else (long_[-1] if long_ else "")
    if not surname:
        return []
    if not long_ or (not comma and len(long_) == 1):
        return [_reading("short", "", surname, letters)]
    given, may = formal(long_[0])
    maybe, alt = [f"{g} {surname}" for g in may], ""
    if not comma and not letters:  # the order may be turned
        turned, also = formal(surname)
        alt = f"{turned} {long_[0]}"
        maybe += [f"{g} {long_[0]}" for g in also]
    return [_reading("full", given, surname, letters, alt, "\n".join(maybe))]


def parse_org(name: str) -> list[dict]:
    """Readings of an organisation's name: its own words, what it does, and initials if it is a short form."""
    text = plain(name)
    if m := _ACRONYM.match(name.strip()):
        return [_reading("short", "", plain(m[2]), plain(m[1]))]
    tokens = [t for t in _tokens(text) if t not in CONNECTORS]
    dotted = {r.replace(".", "") for r in re.findall(r"\b(?:\w\.)+(?:\w\b)?", text)}
    sector, core, letters = "", [], ""
    for t in tokens:
        if len(t) == 1 or (t in dotted and len(t) <= 4 and not _word(t, "legal")):
            letters += t
        elif _word(t, "legal"):
            continue
        elif not sector and _word(t, "sector"):
            sector = _word(t, "sector")
        else:
            core.append(t)
    if not sector:
        for k, t in enumerate(core):
            for full in SECTORS:
                if t.endswith(full) and len(t) > len(full) + 2:
                    core[k], sector = t[: -len(full)], full
    if not core:
        return []
    if letters:
        return [_reading("short", sector, core[0], letters)]
    return [_reading("full", sector, " ".join(core), "", "".join(reversed(core)) if len(core) == 2 else "")]


def is_org(name: str) -> bool:
    """Whether a name has a legal form or a word for what an organisation does."""
    return any(_LEGAL.get(t) or _SECTOR.get(t) or _word(t, "legal") or _word(t, "sector") for t in _tokens(plain(name))) or bool(re.search(r"[&+]", name) or _ACRONYM.match(name.strip()))


_PARSED = "id long, scope string, kind string, form string, given string, surname string, initials string, alt string, maybe string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PARSED.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 8]
    for batch in batches:
        out = []
        for i, scope, name, etype in zip(*(c.to_pylist() for c in batch.columns)):
            label = etype.strip().lower()
            org = label in ORG_TYPES or (label in EITHER_TYPES and is_org(name))
            readings = [(org, r) for r in (parse_org(name) if org else parse_person(name))]
            if not org and label in EITHER_TYPES:
                readings += [(True, r) for r in parse_org(name) if r["form"] == "short" and len(r["initials"]) > 1]
            out += [(i, scope, "org" if o else "person", *(r[n] for n in names[3:])) for o, r in readings]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)


def slip_distance(a: Column, b: Column) -> Column:
    """0 for equal texts, 1 for texts one slip apart (insert, delete, replace, swap neighbours), else null."""
    edits = F.levenshtein(a, b, 2)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    at = F.array_position(differ, True).cast("int")
    swapped = (F.substring(a, at, F.lit(1)) == F.substring(b, at + 1, F.lit(1))) & (F.substring(a, at + 1, F.lit(1)) == F.substring(b, at, F.lit(1))) & (F.size(F.filter(differ, lambda x: x)) == 2)
    return F.when((edits >= 0) & (edits <= 1), edits).when((edits == 2) & (F.length(a) == F.length(b)) & swapped, 1)


def slip_pairs(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of ``index`` (``head, key, ...``) and ``probes`` (``head, probe, again, ...``) with equal heads and at most one slip between key and probe, with ``distance``.

    A key of ``n`` letters has the segments of ``(n - 1) // 2`` letters at its beginning and of
    ``n - 1 - (n - 1) // 2`` at its end; a slip, wherever it is, leaves one of them as it was, at the same
    distance from the beginning or from the end.  So a probe of ``m`` letters looks for keys of
    ``m - 1``, ``m`` and ``m + 1`` letters by two segments each.  Where ``again`` is true the
    probe is itself in the index and leaves shorter keys to find it.  Null and empty keys and probes match
    nothing.  Pairs may come twice.
    """
    front = lambda n: F.floor((n - 1) / 2).cast("int")
    back = lambda n: (n - 1 - F.floor((n - 1) / 2)).cast("int")

    def entry(head: Column, n: Column, side: int, segment: Column) -> Column:
        return F.struct(F.xxhash64(head, n, F.lit(side), segment).alias("h1"), F.xxhash64(F.lit(side), segment, n, head).alias("h2"))

    head, key, probe = F.col("head"), F.col("key"), F.col("probe")
    n, m = F.length(key), F.length(probe)
    own = F.array(entry(head, n, 0, F.substring(key, F.lit(1), front(n))), entry(head, n, 1, F.substring(key, n - back(n) + 1, back(n))))
    left = index.where("key <> '' and head is not null").select("*", F.inline(own)).drop("head")
    look = []
    for delta in (-1, 0, 1):
        k = m + delta
        fits = (k >= 1) & (F.lit(delta >= 0) | ~F.col("again"))
        look += [F.when(fits, entry(head, k, 0, F.substring(probe, F.lit(1), front(k)))), F.when(fits, entry(head, k, 1, F.substring(probe, m - back(k) + 1, back(k))))]
    right = probes.where("probe <> '' and head is not null").select("*", F.inline(F.filter(F.array(*look), lambda x: x.isNotNull()))).drop("head")
    return left.join(right, ["h1", "h2"]).withColumn("distance", slip_distance(key, probe)).where("distance is not null").drop("h1", "h2")


def _fits(kind: Column) -> Column:
    """Whether a short form's initials agree with a full form's words (columns ``initials``, ``s_given``, ``given``, ``surname``, ``f_initials``)."""
    given = F.concat(F.substring("given", 1, 1), F.col("f_initials"))
    letters = F.col("initials")
    both = F.least(F.length(letters), F.length(given))
    person = F.substring(letters, F.lit(1), both) == F.substring(given, F.lit(1), both)
    first = lambda words: F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    core = F.split("surname", " ")
    rest = F.filter(core, lambda w: w != F.col("key"))
    does = F.array(F.col("given"))
    sector = (F.col("s_given") == "") | (F.col("s_given") == F.col("given"))
    org = sector & ((letters == first(F.concat(rest, does))) | (letters == first(rest)) | (letters == first(core)) | (letters == first(F.concat(core, does))))
    return F.when(kind == "person", person).otherwise(org)


def _sole(meet: DataFrame, who: str) -> DataFrame:
    """``a, b``: ``who`` and its group (``distance, group_id``), where the nearest that fits is one group only."""
    best = meet.groupBy(who, "distance").agg(F.min("group_id").alias("lo"), F.max("group_id").alias("hi")).groupBy(who).agg(F.min(F.struct("distance", "lo", "hi")).alias("m"))
    return best.where("m.lo = m.hi").select(F.col(who).alias("a"), F.col("m.lo").alias("b"))


def shortened(full: DataFrame) -> DataFrame:
    """``rep, distance, group_id``: organisations that share all words but one with another, whose word theirs is short for.

    A word is short for a longer one with the same first letter that begins with it, or that
    has all its letters in order, if those after the first are no vowels (Frt, Wks, Mfg).
    ``full`` has ``rep, group_id, scope, given, surname`` of organisations.
    """
    words = full.withColumn("words", F.split("surname", " ")).where(F.size("words") > 1)
    around = F.concat_ws("\n", "scope", "given", F.array_join(F.transform("words", lambda w, i: F.when(i == F.col("at"), F.concat(F.lit("\t"), F.substring(w, 1, 1))).otherwise(w)), " "))
    each = words.select("*", F.posexplode("words").alias("at", "word")).withColumn("around", around).select("rep", "group_id", "around", "word")
    tail = F.expr("substring(word, 2)")
    brief = each.where(F.length("word").between(2, 6)).select("around", F.col("rep").alias("short"), F.col("word").alias("brief"), (~tail.rlike("[aeiou]")).alias("bare"))
    meet = each.join(brief, "around").where(F.length("word") >= F.length("brief") + 2)
    spaced = F.concat(F.lit("^"), F.regexp_replace("brief", "(.)", "$1.*"))
    is_short = F.startswith("word", "brief") | (F.col("bare") & F.regexp_like("word", spaced))
    return meet.where("brief rlike '^[a-z]+$'").where(is_short).select(F.col("short").alias("rep"), F.lit(0).alias("distance"), "group_id")


@kept("groups")
def name_groups(entities: DataFrame) -> DataFrame:
    """``entity_id, group_id``: persons and organisations of a workspace that have several rows or spellings.

    Entities of other types, with a null id, workspace, name or type, and names without
    letters have no group.  Repeated rows are one entity.  The group's id is its smallest entity id.
    """
    label = F.lower(F.trim("etype"))
    rows = entities.where(label.isin(*sorted(PERSON_TYPES | ORG_TYPES | EITHER_TYPES))).select(F.col("id").cast("long"), "workspace", "name", "etype").dropna().distinct()
    parsed = durable(rows.mapInArrow(_parse, _PARSED), "names")

    # copies: one row per reading, the smallest id stands for it
    reading = ["scope", "kind", "form", "given", "surname", "initials", "alt", "maybe"]
    forms = durable(parsed.groupBy(*reading).agg(F.min("id").alias("rep")), "forms")
    same = parsed.join(forms, reading).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # full forms: one part equal, the other at most one slip off
    head = lambda part: F.concat_ws("\n", "scope", "kind", part)
    full = forms.where("form = 'full'").select("*", F.when(F.col("kind") == "org", F.replace("surname", F.lit(" "), F.lit(""))).otherwise(F.col("surname")).alias("own"))
    persons = full.where("kind = 'person'")
    turn = F.split("alt", " ")
    turned = persons.where("alt <> ''").select("scope", "kind", "rep", "initials", turn[0].alias("given"), turn[1].alias("own")).unionByName(full.where("kind = 'org' and alt <> ''").select("scope", "kind", "rep", "initials", "given", F.col("alt").alias("own")))
    asks = full.select("scope", "kind", "rep", "initials", "given", "own", F.lit(True).alias("again")).unionByName(turned.withColumn("again", F.lit(False)))
    by_own = slip_pairs(full.select(head("given").alias("head"), F.col("own").alias("key"), F.col("rep").alias("a"), F.col("initials").alias("i_a")), asks.select(head("given").alias("head"), F.col("own").alias("probe"), "again", F.col("rep").alias("b"), F.col("initials").alias("i_b")))
    by_given = slip_pairs(
        persons.select(head("own").alias("head"), F.col("given").alias("key"), F.col("rep").alias("a"), F.col("initials").alias("i_a")),
        asks.where("kind = 'person'").select(head("own").alias("head"), F.col("given").alias("probe"), "again", F.col("rep").alias("b"), F.col("initials").alias("i_b")),
    ).where("distance = 1")
    # two given names that both occur often are two names, not one and its slip
    often = durable(persons.groupBy("given").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN), "often")
    by_given = by_given.join(often.toDF("key", "n_key"), "key", "left").join(often.toDF("probe", "n_probe"), "probe", "left").where(f"n_key is null or n_probe is null or least(n_key, n_probe) * {MUCH} < greatest(n_key, n_probe)")
    agree = (F.col("i_a") == "") | (F.col("i_b") == "") | (F.col("i_a") == F.col("i_b"))
    links = by_own.select("a", "b", "i_a", "i_b").unionByName(by_given.select("a", "b", "i_a", "i_b")).where(agree & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    strong = durable(links.distinct().unionByName(same).distinct(), "links")

    # uncertain readings of full forms
    grouped = lambda links: full.join(components(links).withColumnRenamed("entity_id", "rep"), "rep", "left").withColumn("group_id", F.coalesce("group_id", "rep"))
    sure = durable(grouped(strong), "sure")
    maybe = persons.where("maybe <> ''").select("scope", "kind", "initials", F.col("rep").alias("short"), F.explode(F.split("maybe", "\n")).alias("r")).select("*", F.split("r", " ")[0].alias("given"), F.split("r", " ")[1].alias("own"))
    read = slip_pairs(
        sure.where("kind = 'person'").select(head("given").alias("head"), F.col("own").alias("key"), "group_id", F.col("initials").alias("i_a")),
        maybe.select(head("given").alias("head"), F.col("own").alias("probe"), F.lit(False).alias("again"), "short", F.col("initials").alias("i_b")),
    ).where(agree).select(F.col("short").alias("rep"), "distance", "group_id")
    told = _sole(read.unionByName(shortened(sure.where("kind = 'org'"))), "rep")
    linked = durable(strong.unionByName(told), "told")

    # short forms: where exactly one group of the workspace fits
    group = grouped(linked)
    words = group.select("kind", "given", "surname", F.col("initials").alias("f_initials"), "group_id", head(F.lit("")).alias("head"), F.explode(F.when(F.col("kind") == "person", F.array("surname")).otherwise(F.split("surname", " "))).alias("key"))
    short = durable(forms.where("form = 'short'").select(head(F.lit("")).alias("head"), F.col("surname").alias("probe"), F.lit(False).alias("again"), F.col("rep").alias("short"), "initials", F.col("given").alias("s_given"), F.col("kind").alias("s_kind")), "short")
    meet = durable(slip_pairs(words, short).where(_fits(F.col("kind"))).select("short", "distance", "group_id"), "meet")
    joined = _sole(meet, "short")
    # short forms that fit no group belong together if they agree among themselves
    lone = short.join(meet.select("short").distinct(), "short", "left_anti").where("s_kind = 'person'")
    peers = lone.groupBy("head", "probe").agg(F.min("short").alias("b"), F.countDistinct(F.when(F.col("initials") != "", F.substring("initials", 1, 1))).alias("letters")).where("letters <= 1")
    alone = lone.join(peers, ["head", "probe"]).where("short <> b").select(F.col("short").alias("a"), "b")
    return components(linked.unionByName(joined).unionByName(alone))


def name_pairs(entities: DataFrame) -> DataFrame:
    """``entity_id_a, entity_id_b``, a < b: the pairs of ids within each group of :func:`name_groups`."""
    groups = name_groups(entities)
    a, b = groups.select("group_id", F.col("entity_id").alias("entity_id_a")), groups.select("group_id", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "group_id").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
