"""Surfacing entities from text.

Input chunks have ``workspace, chunk_id, name, text``; the order of a workspace is that of
``chunk_id``, which decides every "first".  Null and empty texts yield nothing, repeated
chunk rows have to be removed before (:func:`text_chunks` does), an empty table gives an
empty result, and other columns are ignored.

Entities come as ``workspace, name, ...`` with their counts, mentions as one row for each
chunk and name.  Both come from the same candidates: counting is partial before the
shuffle, and what is cut off by rank is cut per workspace with a ranked limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import patterns as P
from weftgraph.functions import text as T
from weftgraph.operators.incremental import current_versions

TEXT_KINDS = ("docs", "pdf", "spec")


def current_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per artifact: all columns of its version with the latest time, ties as in :func:`current_versions`."""
    order = F.struct("ingested_at", "sha", "path", "workspace")
    rest = F.struct(*[c for c in artifacts.columns if c != "id"])
    best = artifacts.where("id is not null").groupBy("id").agg(F.max_by(rest, order).alias("v"))
    return best.select("id", "v.*")


def kind_of(kind: Column) -> Column:
    """Kind of an artifact without regard to case and outer blanks."""
    return F.lower(F.trim(kind))


def text_chunks(chunks: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...] = TEXT_KINDS) -> DataFrame:
    """``workspace, chunk_id, artifact_id, name, text`` of chunks whose artifact has one of the kinds; repeats once."""
    wanted = current_artifacts(artifacts.select("id", "workspace", "path", "kind", "sha", "ingested_at")).where(kind_of(F.col("kind")).isin(*kinds)).select(F.col("id").alias("artifact_id"))
    rows = chunks.select("workspace", F.col("id").alias("chunk_id"), "artifact_id", "name", "text").dropDuplicates(["chunk_id"])
    return rows.join(wanted, "artifact_id").select("workspace", "chunk_id", "artifact_id", "name", "text")


def ranked(counted: DataFrame, min_count: int, top_k: int) -> DataFrame:
    """Rows with at least ``min_count``, the ``top_k`` of each workspace: by count, then by first occurrence (column ``first``)."""
    order = Window.partitionBy("workspace").orderBy(F.col("count").desc(), F.col("first").asc())
    return counted.where(F.col("count") >= min_count).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)


def _candidates(chunks: DataFrame, found: Column) -> DataFrame:
    return chunks.select("workspace", "chunk_id", "name", F.posexplode(found).alias("pos", "surface"))


def proper_noun_counts(chunks: DataFrame, min_count: int = 4, top_k: int = 60) -> DataFrame:
    """``workspace, name, count, first_page, rank`` of recurring proper nouns; the page is that of the first chunk that has one."""
    rows = _candidates(chunks, T.proper_nouns(F.col("text"))).withColumn("page", T.page_of(F.col("name")))
    seen = F.struct("chunk_id", "pos")
    counted = rows.groupBy("workspace", F.col("surface")).agg(
        F.count(F.lit(1)).alias("count"), F.min(seen).alias("first"), F.min_by("page", F.when(F.col("page").isNotNull(), seen)).alias("first_page")
    )
    return ranked(counted, min_count, top_k).select("workspace", F.col("surface").alias("name"), "count", "first_page", "rank")


def proper_noun_mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``workspace, name, chunk_id``: one row for each surfaced name and chunk that has it."""
    rows = _candidates(chunks, T.proper_nouns(F.col("text"))).select("workspace", F.col("surface").alias("name"), "chunk_id")
    return rows.join(names.select("workspace", "name"), ["workspace", "name"], "left_semi").distinct()


def salient_term_counts(chunks: DataFrame, min_count: int = 4, top_k: int = 80, most: int = 3) -> DataFrame:
    """``workspace, name, term, count, rank`` of frequent phrases; name is the spelling seen first, term its lower case."""
    rows = _candidates(chunks, T.phrases(F.col("text"), most)).withColumn("term", F.lower("surface"))
    counted = rows.groupBy("workspace", "term").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("chunk_id", "pos", "surface")).alias("first"))
    return ranked(counted, min_count, top_k).select("workspace", F.col("first.surface").alias("name"), "term", "count", "rank")


def _numbered(form: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(form).alias("form"), i.cast("int").alias("pos"), x["w"].alias("whole"), x["p"].alias("part"))


def _matches(chunks: DataFrame, forms: list[str]) -> DataFrame:
    """``workspace, chunk_id, form, pos, whole, part``: matches of several patterns, with the whole match and its group."""
    all_ = []
    for k, form in enumerate(forms):
        flags, body = ("(?U)", form) if not form.startswith("(?") or form[2] == ":" else (f"(?{form[2:form.index(')')]}U)", form[form.index(")") + 1 :])
        whole = F.regexp_extract_all(F.col("text"), F.lit(f"{flags}({body})"), F.lit(1))
        part = F.regexp_extract_all(F.col("text"), F.lit(f"{flags}({body})"), F.lit(2))
        all_.append(F.transform(F.arrays_zip(whole.alias("w"), part.alias("p")), _numbered(k)))
    return chunks.select("workspace", "chunk_id", "text", F.inline(F.flatten(F.array(*all_))))


def defined_terms(chunks: DataFrame) -> DataFrame:
    """``workspace, name, chunk_id, form, pos, definition``: one row for each match of a defining form.

    definition is the text from the match on, 160 characters with line breaks as spaces.
    Terms of fewer than two characters are left out.
    """
    rows = _matches(chunks, P.DEFINITIONS)
    name = F.regexp_replace(F.regexp_replace(F.col("part"), r"(?U)\s+", " "), r"^[ ,]+|[ ,]+\z", "")
    start = T.position(F.col("text"), F.col("whole"))
    snippet = F.replace(F.substring(F.col("text"), start, F.lit(160)), F.lit("\n"), F.lit(" "))
    return rows.select("workspace", name.alias("name"), "chunk_id", "form", "pos", snippet.alias("definition")).where(F.length("name") >= 2)


def defined_term_entities(chunks: DataFrame) -> DataFrame:
    """``workspace, name, mentions, definition``: each term with its first definition and its number of matches."""
    rows = defined_terms(chunks)
    return rows.groupBy("workspace", "name").agg(F.count(F.lit(1)).alias("mentions"), F.min_by("definition", F.struct("chunk_id", "form", "pos")).alias("definition"))


def structural_markers(chunks: DataFrame, preset: str | None = None) -> DataFrame:
    """``workspace, name, chunk_id, line, form, pos``: one row for each mark of a division; labels of at most 90 characters.

    An unknown or missing preset takes all.  line is the chunk's line on which the match
    begins, which may be a blank line before the label.
    """
    forms = P.MARKERS.get(preset or "", [p for group in P.MARKERS.values() for p in group])
    rows = _matches(chunks, forms)
    label = T.one_line(F.col("part"))
    line = T.line_at(F.col("text"), T.position(F.col("text"), F.col("whole")))
    return rows.select("workspace", label.alias("name"), "chunk_id", line.alias("line"), "form", "pos").where((F.length("name") > 0) & (F.length("name") <= 90))


def marker_entities(chunks: DataFrame, preset: str | None = None) -> DataFrame:
    """``workspace, name, mentions, line``: each label with its first line and its number of marks."""
    return structural_markers(chunks, preset).groupBy("workspace", "name").agg(F.count(F.lit(1)).alias("mentions"), F.min_by("line", F.struct("chunk_id", "form", "pos")).alias("line"))


def _prefixes(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(name, F.lit(1), n))


def cross_references(chunks: DataFrame, sections: DataFrame, longest: int = 200) -> DataFrame:
    """``workspace, src_id, dst_id``, distinct: from the division a chunk belongs to, to the one its text refers to.

    ``sections`` has ``workspace, id, name``.  A chunk belongs to the first section (by id)
    whose name is its name, a beginning of it, or begins with it; a reference means the
    first section with that number; references to oneself are left out.  Names are
    matched by joining on their beginnings, one row per distinct name and length, so no
    pair of names is compared.  Names longer than ``longest`` are matched by their first
    ``longest`` characters and then checked in full.
    """
    secs = sections.where("name is not null and id is not null").groupBy("workspace", "name").agg(F.min("id").alias("id"))
    named = chunks.where("name <> ''").select("workspace", F.col("name").alias("chunk_name")).distinct()
    cut = lambda c: F.substring(F.col(c), 1, longest)
    longer = named.select("workspace", "chunk_name", F.explode(_prefixes(cut("chunk_name"))).alias("key")).join(secs.select("workspace", cut("name").alias("key"), "name", "id"), ["workspace", "key"]).where(F.startswith("chunk_name", "name"))
    shorter = secs.where("name <> ''").select("workspace", "name", "id", F.explode(_prefixes(cut("name"))).alias("key")).join(named.select("workspace", cut("chunk_name").alias("key"), "chunk_name"), ["workspace", "key"]).where(F.startswith("name", "chunk_name"))
    columns = ["workspace", "chunk_name", "id"]
    source = longer.select(*columns).unionByName(shorter.select(*columns)).groupBy("workspace", "chunk_name").agg(F.min("id").alias("src_id"))
    number = F.regexp_extract(F.col("name"), "(?U)" + P.CROSS_REFERENCE, 1)
    numbered = secs.select("workspace", number.alias("number"), "id").where("number <> ''").groupBy("workspace", "number").agg(F.min("id").alias("dst_id"))
    refs = chunks.where("name <> ''").select("workspace", F.col("name").alias("chunk_name"), F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("(?U)" + P.CROSS_REFERENCE), F.lit(1)))).alias("number"))
    return refs.join(source, ["workspace", "chunk_name"]).join(numbered, ["workspace", "number"]).where("src_id <> dst_id").select("workspace", "src_id", "dst_id").distinct()


def code_spans(chunks: DataFrame) -> DataFrame:
    """``workspace, chunk_id, name, surface``: symbols named in code spans, each once per chunk with its first surface."""
    spans = F.regexp_extract_all(F.col("text"), F.lit(P.CODE_SPAN), F.lit(1))
    rows = chunks.select("workspace", "chunk_id", F.posexplode(spans).alias("pos", "surface")).withColumn("name", T.span_symbol(F.col("surface"))).where("name is not null")
    return rows.groupBy("workspace", "chunk_id", "name").agg(F.min_by("surface", "pos").alias("surface"))


def connectors(sources: DataFrame) -> DataFrame:
    """``artifact_id, kind, role, key, raw, line``: endpoints in full source texts, each key once with its first place.

    ``sources`` has ``artifact_id, text``.  First is by pattern, then by position.
    """
    rows = _matches(sources.select(F.lit("").alias("workspace"), F.col("artifact_id").alias("chunk_id"), "text"), [p for _, _, p in P.CONNECTORS])
    kinds, roles = F.array(*[F.lit(k) for k, _, _ in P.CONNECTORS]), F.array(*[F.lit(r) for _, r, _ in P.CONNECTORS])
    rows = rows.withColumn("kind", F.element_at(kinds, F.col("form") + 1)).withColumn("role", F.element_at(roles, F.col("form") + 1))
    rows = rows.withColumn("key", T.connector_key(F.col("kind"), F.col("part"))).where("key is not null")
    line = T.line_at(F.col("text"), T.position(F.col("text"), F.col("whole")))
    return (
        rows.select(F.col("chunk_id").alias("artifact_id"), "kind", "role", "key", "form", "pos", F.col("part").alias("raw"), line.alias("line"))
        .groupBy("artifact_id", "kind", "role", "key")
        .agg(F.min(F.struct("form", "pos", "raw", "line")).alias("m"))
        .select("artifact_id", "kind", "role", "key", F.col("m.raw").alias("raw"), F.col("m.line").alias("line"))
    )


__all__ = [
    "TEXT_KINDS", "code_spans", "connectors", "cross_references", "current_artifacts", "current_versions", "defined_term_entities", "defined_terms", "kind_of",
    "marker_entities", "proper_noun_counts", "proper_noun_mentions", "ranked", "salient_term_counts", "structural_markers", "text_chunks",
]
