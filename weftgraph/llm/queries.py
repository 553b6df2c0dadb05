"""Queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import baskets, codefiles, components, leakage, mixing, names, spans, terms


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.name_pairs(_table(spark, sf, "entities"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entity that has other spellings: its group and the group's size."""
    groups = names.name_groups(_table(spark, sf, "entities"))
    return groups.join(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("members")), "group_id").select("entity_id", "group_id", "members")


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_table(_table(spark, sf, "mentions"), _table(spark, sf, "entities"), _table(spark, sf, "shared_entities"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_terms(spark, sf).where("mark is not null").select("workspace", "field_name", "term", "mark")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "mentions").select(F.col("workspace").alias("scope"), F.col("chunk_id").alias("basket"), F.col("entity_id").alias("item"))
    return baskets.frequent_pairs(rows)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(F.col("scope").alias("workspace"), F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p4_found with their counts, lift and conviction."""
    return _pairs(spark, sf).select(F.col("scope").alias("workspace"), F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"), "n_ab", "n_a", "n_b", F.col("n").alias("n_chunks"), F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.regexp_replace(F.lower(F.trim("edge_type")), r"[_\- ]+", "_")
    edges = _table(spark, sf, "edges").where((F.col("asserted") == 1) & kind.isin("same_as", "alias_of"))
    return components.components(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))


def p7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """By path and lang, and by the notices in the first chunk of a file."""
    heads = _table(spark, sf, "chunks").where("start_line = 1").select("artifact_id", "text")
    return codefiles.not_hand_written(_table(spark, sf, "artifacts"), heads)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_reasons(spark, sf).select("artifact_id")


def _leaks(spark: SparkSession, sf: str, **how: float) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"), **how)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where(F.col("run_words") >= leakage.RUN).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """All passages found at five-word shingles and a similarity of 0.8, with the size they have and their longest equal run."""
    return _leaks(spark, sf).withColumn("similarity", F.round("similarity", 6))


def p8_altered(spark: SparkSession, sf: str) -> DataFrame:
    """Whole items with some words changed: the same search by single words at 0.7, as any changed word costs five shingles of five."""
    return _leaks(spark, sf, shingle=1, least=0.7).withColumn("similarity", F.round("similarity", 6))


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, float]:
    """Token counts, targets, and as budget the tokens of all documents."""
    sizes, targets = mixing.token_sizes(_table(spark, sf, "documents")), _table(spark, sf, "mix_targets")
    return sizes, targets, float(sizes.agg(F.sum("tokens")).first()[0] or 0)


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    """As many tokens as the documents have, if the limits allow it, at the shares nearest to the targets by bisected temperature."""
    return mixing.mix(*_mixture(spark, sf))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target, planned and reached shares of p9_selection, and its exponent."""
    sizes, targets, budget = _mixture(spark, sf)
    return mixing.shares(mixing.mix(sizes, targets, budget), sizes, targets, budget)


def p9_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact target shares, at the size that the scarcest source allows."""
    sizes, targets, _ = _mixture(spark, sf)
    return mixing.mix(sizes, targets)


def p9_exact_shares(spark: SparkSession, sf: str) -> DataFrame:
    sizes, targets, _ = _mixture(spark, sf)
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


def p9_entropy_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Own shares of the sources, exponentiated until they are as even as the targets (same entropy)."""
    sizes, targets, budget = _mixture(spark, sf)
    shares = {r.source: r.s for r in targets.select(mixing.source_name(F.col("source")).alias("source"), F.col("target_share").alias("s")).groupBy("source").agg(F.max("s").alias("s")).where("s > 0").limit(mixing.MAX_SOURCES).collect()}
    goal = mixing.entropy({s: x / sum(shares.values()) for s, x in shares.items()})
    return mixing.shares(mixing.mix(sizes, targets, budget, target_entropy=goal), sizes, targets, budget, goal)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_pairs(_table(spark, sf, "documents"))


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of each document that occur in other documents too."""
    return spans.passages(_table(spark, sf, "documents"))


def p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document occurs elsewhere."""
    return spans.coverage(_table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_terms, p4_found, p4_scores, p6_found, p7_found, p7_reasons, p8_found, p8_leaks, p8_altered, p9_selection, p9_shares, p9_exact, p9_exact_shares, p9_entropy_shares, p10_found, p10_passages, p10_coverage)}


_TERMS = """
WITH named AS (
  SELECT DISTINCT id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS term
  FROM (SELECT id, name FROM entities UNION ALL SELECT id, name FROM shared_entities)
), by_name AS (
  SELECT m.workspace, n.term, m.chunk_id AS r, count(*) AS occ
  FROM (SELECT DISTINCT id, workspace, entity_id, chunk_id FROM mentions) m JOIN named n ON m.entity_id = n.id
  WHERE n.term <> '' AND m.workspace IS NOT NULL AND m.chunk_id IS NOT NULL GROUP BY ALL
), rows AS (SELECT workspace, id, json_extract(props, '$.tags') AS tags FROM (SELECT DISTINCT * FROM entities) WHERE json_valid(props)
), strings AS (
  SELECT workspace, id, unnest(CASE json_type(tags) WHEN 'ARRAY' THEN from_json(tags, '["json"]') WHEN 'VARCHAR' THEN [tags] ELSE [] END) AS tag FROM rows
), by_tag AS (
  SELECT workspace, term, id AS r, count(*) AS occ
  FROM (SELECT workspace, id, lower(trim(regexp_replace(json_extract_string(tag, '$'), '\\s+', ' ', 'g'))) AS term FROM strings WHERE json_type(tag) = 'VARCHAR')
  WHERE term <> '' GROUP BY ALL
), counts AS (
  SELECT workspace, 'name' AS field_name, term, sum(occ)::BIGINT AS occurrences, count(*) AS records FROM by_name GROUP BY ALL
  UNION ALL SELECT workspace, 'tag', term, sum(occ)::BIGINT, count(*) FROM by_tag GROUP BY ALL
), totals AS (
  SELECT workspace, 'name' AS field_name, count(DISTINCT chunk_id) AS total FROM mentions GROUP BY ALL
  UNION ALL SELECT workspace, 'tag', count(DISTINCT id) FROM entities GROUP BY ALL
), marked AS (
  SELECT workspace, field_name, term, occurrences, records, total,
    CASE WHEN field_name = 'name' THEN CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > total * 4 THEN 'common' END
         ELSE CASE WHEN records <= 1 THEN 'rare' WHEN records * 10 > total THEN 'common' END END AS mark
  FROM counts JOIN totals USING (workspace, field_name)
)
"""

_PAIRS = """
WITH base AS (SELECT DISTINCT workspace, chunk_id, entity_id FROM mentions WHERE workspace IS NOT NULL AND chunk_id IS NOT NULL AND entity_id IS NOT NULL),
n AS (SELECT workspace, count(DISTINCT chunk_id) AS n_chunks FROM base GROUP BY 1),
one AS (SELECT workspace, entity_id, count(*) AS k FROM base GROUP BY 1, 2),
two AS (SELECT a.workspace, a.entity_id AS entity_id_a, b.entity_id AS entity_id_b, count(*) AS n_ab
        FROM base a JOIN base b ON a.workspace = b.workspace AND a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id GROUP BY ALL HAVING count(*) >= 5),
scored AS (
  SELECT two.*, x.k AS n_a, y.k AS n_b, n_chunks FROM two JOIN n USING (workspace)
  JOIN one x ON x.workspace = two.workspace AND x.entity_id = entity_id_a JOIN one y ON y.workspace = two.workspace AND y.entity_id = entity_id_b
  WHERE n_ab * n_chunks >= 8 * x.k * y.k
)
"""

_GROUPS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT src_id AS a, dst_id AS b FROM edges
  WHERE asserted = 1 AND src_id <> dst_id AND regexp_replace(lower(trim(edge_type)), '[_\\- ]+', '_', 'g') IN ('same_as', 'alias_of')
), ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(id, r) AS (
  SELECT a, a FROM ends UNION SELECT ends.b, reach.r FROM reach JOIN ends ON ends.a = reach.id WHERE reach.r < ends.b
)
SELECT id AS entity_id, min(r) AS group_id FROM reach GROUP BY id
"""


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _reasons_sql() -> str:
    """The rules of the code files as expressions: ``p`` is the path with a slash before it, ``n`` its last part."""
    hit = lambda column, pattern: f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"
    c = codefiles
    place = f"regexp_extract(p, '^(.*?)/{_any(c.OUTSIDE)}/[^/]+/', 1)"
    cases = [
        (hit("p", f"/{_any(c.INSTALLED)}/"), "vendored"), (hit("p", f"/{_any(c.VENDORED)}/[^/]+/"), "vendored"),
        (f"{hit('p', f'/{_any(c.OUTSIDE)}/[^/]+/')} AND NOT regexp_matches({place} || '/', '/{_any(c.SOURCE_TREE)}/')", "vendored"),
        (hit("p", f"/{_any(c.GENERATED)}/"), "generated"), (hit("p", f"/{_any(c.BUNDLED)}/"), "minified"), (hit("n", f"{_any(c.GENERATED_ENDINGS)}$"), "generated"),
        (hit("n", f"{_any(c.MINIFIED_ENDINGS)}$"), "minified"), (hit("n", f"^{_any(c.LOCK_FILES)}$"), "generated"),
    ]
    for column, rules in (("n", c.BY_NAME), ("p", c.BY_PATH)):
        for why, pattern in rules:
            plain = pattern.replace("(?=[a-f]*[0-9])", "")  # this dialect looks at what it found instead
            also = f" AND regexp_matches(regexp_extract({column}, '{plain}'), '[0-9]')" if plain != pattern else ""
            cases.append((hit(column, plain) + also, why))
    data = ", ".join(f"'{x}'" for x in c.DATA_LANGS)
    cases.append((f"lower(trim(lang)) IN ({data}) AND {hit('n', c._SOURCE)}", "data"))
    whens = "\n".join(f"WHEN {test} THEN '{why}'" for test, why in cases)
    notice = f"(?m){c.COMMENT}(?:[^\\n]*{_any(c.NOTICES)}|{_any(c.OPENINGS)})"
    return f"""
WITH f AS (SELECT DISTINCT id AS artifact_id, lang, '/' || array_to_string(list_filter(string_split(replace(lower(path), chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM artifacts WHERE lower(trim(kind)) = 'code' AND id IS NOT NULL),
r AS (SELECT artifact_id, CASE {whens} END AS reason FROM (SELECT *, string_split(p, '/')[-1] AS n FROM f)),
h AS (SELECT DISTINCT artifact_id FROM chunks WHERE start_line = 1 AND {hit("lower(text)", notice)})
SELECT artifact_id, coalesce(min(reason), 'notice') AS reason FROM (SELECT artifact_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT f.artifact_id, NULL FROM f JOIN h USING (artifact_id)) GROUP BY artifact_id
"""


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)
"""


_SPANS = """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, len(text) - 298)) AS i FROM documents WHERE len(text) >= 300)),
held AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
marks AS (SELECT w.doc_id, w.i, h FROM w JOIN held USING (h)),
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS new FROM marks)),
passage AS (SELECT doc_id, (min(i) - 1)::INTEGER AS start, (max(i) - min(i) + 300)::INTEGER AS length FROM island GROUP BY doc_id, k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TERMS + "SELECT workspace, field_name, term, mark FROM marked WHERE mark IS NOT NULL",
        "p3_terms": _TERMS + "SELECT workspace, field_name, term, occurrences, records, total, mark FROM marked",
        "p4_found": _PAIRS + "SELECT workspace, entity_id_a, entity_id_b FROM scored",
        "p4_scores": _PAIRS + """SELECT workspace, entity_id_a, entity_id_b, n_ab, n_a, n_b, n_chunks,
            round(n_ab::DOUBLE * n_chunks::DOUBLE / (n_a::DOUBLE * n_b::DOUBLE), 6) AS lift,
            round(CASE WHEN n_ab < n_a THEN (1 - n_b::DOUBLE / n_chunks::DOUBLE) / (1 - n_ab::DOUBLE / n_a::DOUBLE) END, 6) AS conviction FROM scored""",
        "p6_found": _GROUPS,
        "p7_reasons": _reasons_sql(),
        "p7_found": f"SELECT artifact_id FROM ({_reasons_sql()})",
        "p8_found": _LEAKS,
        "p10_found": _SPANS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM marks) a JOIN (SELECT DISTINCT doc_id, h FROM marks) b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p10_passages": _SPANS + "SELECT * FROM passage",
        "p10_coverage": _SPANS + """, same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE len(text) >= 300)
            SELECT d.doc_id, coalesce(len(text), 0)::BIGINT AS n_chars, coalesce(p.n, 0) AS passages, coalesce(p.chars, 0)::BIGINT AS shared_chars, CASE WHEN same.n > 1 THEN class_id END AS class_id
            FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length) AS chars FROM passage GROUP BY 1) p USING (doc_id) LEFT JOIN same USING (doc_id)""",
    }
