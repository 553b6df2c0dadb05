"""Text expressions.  All are null for null input unless stated, and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph import patterns as P


def sha16(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def stable_id(*parts: Column | str) -> Column:
    """64-bit id of what makes something unique.  A null part is a part of its own, where the plain hash would pass it over."""
    return F.xxhash64(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\0")) for p in parts])


def position(text: Column, found: Column) -> Column:
    """1-based position of ``found`` in ``text``, 0 if absent."""
    return F.position(found, text)


def line_at(text: Column, at: Column) -> Column:
    """1-based line of the 1-based character ``at``."""
    before = F.substring(text, F.lit(1), at - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def one_line(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def symbol_key(name: Column) -> Column:
    """Name without ``_``, ``-`` and white space, lower case: equal for snake, kebab and camel case."""
    return F.lower(F.regexp_replace(name, r"(?U)[_\s\-]+", ""))


def entity_key(name: Column) -> Column:
    """Trimmed, one leading article and all punctuation dropped, lower case, single spaces.  Empty for punctuation only."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+\z", ""), r"(?iU)^(?:the|a|an)\s+", "")
    return one_line(F.lower(F.regexp_replace(bare, r"(?U)[^\w\s]", "")))


def page_of(name: Column) -> Column:
    """Number of a page from a chunk named ``p<number>``; null for other names."""
    return F.when(name.rlike(r"\Ap[0-9]{1,9}\z"), F.substring(name, 2, 9).cast("int"))


def span_symbol(span: Column) -> Column:
    """Identifier of a code span: up to a parenthesis, after the last dot, at least three characters; else null."""
    token = F.element_at(F.split(F.element_at(F.split(F.regexp_replace(span, r"(?U)^\s+|\s+\z", ""), r"\("), 1), r"\."), -1)
    return F.when(token.rlike(r"(?U)\A[A-Za-z_]\w{2,}\z"), token)


def proper_nouns(text: Column) -> Column:
    """Candidates for proper nouns in order of occurrence, without those that function words begin."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + P.PROPER_NOUN), F.lit(1))
    stop = F.array(*[F.lit(w) for w in P.NOT_NAMES])
    return F.filter(found, lambda t: ~F.array_contains(stop, F.element_at(F.split(t, r"(?U)\s+"), 1)))


def phrases(text: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` content words within stretches that no other token interrupts, in order.

    A content word has at least three ASCII letters and nothing else and is no function word.
    """
    stop = F.array(*[F.lit(w) for w in P.FUNCTION_WORDS])
    tokens = F.regexp_extract_all(text, F.lit(P.PHRASE_TOKEN), F.lit(1))
    marked = F.transform(tokens, lambda t: F.when(t.rlike(r"\A[A-Za-z]{3,}\z") & ~F.array_contains(stop, F.lower(t)), t).otherwise(F.lit("|")))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.filter(F.split(r, " "), lambda w: w != ""))

    def grams(run: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(n) for n in range(1, most + 1)]), lambda n: n <= F.size(run))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(run) - n + 1), lambda i: F.array_join(F.slice(run, i, n), " "))))

    return F.flatten(F.transform(F.filter(runs, lambda r: F.size(r) > 0), grams))


def route_key(raw: Column) -> Column:
    """A route as it is compared: path of a URL, parameters as ``{}``, no trailing slash; null if too general."""
    trimmed = F.trim(raw)
    path = F.when(F.contains(trimmed, F.lit("://")), F.coalesce(F.nullif(F.regexp_extract(trimmed, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))).otherwise(trimmed)
    same = F.regexp_replace(path, P.ROUTE_PARAMETER, "{}")
    short = F.when(F.length(same) > 1, F.regexp_replace(same, r"/+\z", "")).otherwise(same)
    words = F.exists(F.split(short, "/"), lambda s: F.length(s) >= 2)
    return F.when(words & ~F.lower(short).isin(P.GENERAL_ROUTES), short)


def connector_key(kind: Column, raw: Column) -> Column:
    """Key of an endpoint for comparison, or null if ``raw`` is no valid key of its kind."""
    key = F.trim(raw)
    http = F.when((F.startswith(key, F.lit("/")) | F.contains(key, F.lit("://"))) & (F.length(key) > 1), route_key(key))
    topic = F.when(key.rlike(r"(?U)\A[A-Za-z][\w.\-]{2,}\z"), F.lower(key))
    return F.when(kind == "http", http).when(kind == "topic", topic)


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_ascii(text: Column, query: str) -> Column:
    """``text LIKE '%query%'`` where only A to Z ignore case; ``%`` and ``_`` in the query are wildcards, ``\\`` is plain."""
    low = "".join(c.lower() if c.isascii() else c for c in query).replace("\\", "\\\\")
    return ascii_lower(text).like(f"%{low}%")


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and ``_``."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")


def json_object(props: Column) -> Column:
    """Props as a variant, null where they are null or no valid JSON."""
    return F.try_parse_json(props)


def json_text(props: Column, path: str) -> Column:
    """A field of JSON as text: strings as they are, numbers in digits; null if absent, null or not scalar.  Invalid JSON gives null."""
    return F.try_variant_get(F.try_parse_json(props), path, "string")


def json_number(props: Column, path: str) -> Column:
    """A field of JSON as double: a number, or a string that holds one; else null."""
    return json_text(props, path).try_cast("double")


def json_int(props: Column, path: str) -> Column:
    """A field of JSON as long: an integer, or a string that holds one; else null."""
    return json_text(props, path).try_cast("long")


def json_fields(props: Column) -> Column:
    """Fields of a JSON object by name, with their values as they are; none for null, invalid JSON and what is no object."""
    kind = "map<string,variant>"
    return F.coalesce(F.from_json(props, kind), F.from_json(F.lit("{}"), kind))


def with_field(props: Column, name: str, value: Column) -> Column:
    """JSON with a field set to ``value``, which is JSON text itself; what is no object becomes one."""
    others = F.map_filter(json_fields(props), lambda k, _: k != name)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(name), F.parse_json(value))))


def without_field(props: Column, name: str) -> Column:
    """JSON without a field; null and what is no object stay as they are."""
    kept = F.map_filter(F.from_json(props, "map<string,variant>"), lambda k, _: k != name)
    return F.coalesce(F.to_json(kept), props)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of the same length in double precision; lengths below 1e-9 count as 1e-9."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def norm(a: Column) -> Column:
    """Length of a vector, at least 1e-9."""
    return F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-9))


def safe_label(text: Column) -> Column:
    """Text for a diagram's label: quotes as ``'``, line breaks as spaces, trimmed."""
    return F.trim(F.translate(text, "\"`\n", "'' "))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single dashes, at most 60 characters; ``artifact`` if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", ""), 1, 60)
    return F.when(s == "", "artifact").otherwise(s)
