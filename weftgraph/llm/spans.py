"""Spans of at least ``least`` characters that occur verbatim in more than one document.

Texts are cut into content-defined chunks: a gear rolling hash over 64 characters runs
along the text, and a position is a cut if its hash is the smallest in some window of
``WINDOW`` positions.  A chunk reaches from ``CONTEXT`` characters before one cut to the
next cut, so chunks overlap and none is shorter than ``CONTEXT``.

Why no span is missed: let two texts share a span S of ``CONTEXT + 2 * WINDOW - 1``
characters.  The first and the last ``WINDOW`` positions of S whose context lies in S are
disjoint windows with the same hashes in both texts, so both texts cut at the same
smallest position F in the first and L in the last.  A position between F and L is a cut
through a window that lies in S (the same in both texts) or through one that sticks out
of S; the latter holds F or L, so its smallest hash is theirs and the position ties with
it, which makes it a cut of the inner window too.  Hence all cuts from F to L agree, and at least one chunk
lies wholly in S in both texts.  Insertions elsewhere shift nothing, and no minimum or
maximum chunk length breaks the argument.  ``least`` must be at least that length.

Chunks are compared by digest.  Occurrences of a digest in more than one document then
meet, with as much text around them as decides whether they belong to a span of
``least`` characters.  Chunks of up to ``GROUP`` occurrences meet pair by pair.  More frequent ones go by classes:

1. A span of ``least`` characters around a chunk reaches at least half of what it has more
   than the chunk to the left or to the right of it.  So an occurrence whose chunk with that much on the left is
   in no other document, and with that much on the right neither, is in no shared span: two rows decide that.
2. Occurrences with the same text as far as any such span reaches form a class; there are
   as many classes as there are different surroundings, not as many as copies.
3. One occurrence of each class gives the digests of its windows of ``least`` characters, and classes that
   have a window in common share it.  What is found for a class holds for all of its occurrences.

The work is linear in the occurrences, and characters are looked at once for each class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable, kept, sized
from weftgraph.plans.skew import split_join

LEAST = 300
GEAR = 64
CONTEXT = 150
WINDOW = 75
#: Occurrences of a digest up to which they are compared pair by pair.
GROUP = 48
#: Characters hashed at a time (fits a core's cache); a longer text is taken as one piece.
PIECE = 200_000

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: 64 scrambled bits for each number."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Tables:
    """Random numbers of the characters and powers of the digest's base, made once in a worker."""

    def __init__(self) -> None:
        self.gear = _mix(np.arange(0x110000))
        self.digit = _mix(np.arange(0x110000) + 0x200000)
        self.power = self.inverse = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            size = max(n, 2 * PIECE)
            ones = np.full(size, _BASE)
            ones[0] = 1
            inv = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            inv[0] = 1
            self.power, self.inverse = np.cumprod(ones), np.cumprod(inv)
        return self.power, self.inverse


_tables: Tables | None = None


def tables() -> Tables:
    global _tables
    if _tables is None:
        _tables = Tables()
    return _tables


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc, forward: bool) -> np.ndarray:
    """Extreme of ``x[i : i + width]`` (forward) or ``x[i - width + 1 : i + 1]``, cut off at the ends."""
    y, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if forward:
            y[:-step] = pick(y[:-step], y[step:])
        else:
            y[step:] = pick(y[step:], y[:-step].copy())
        have += step
    return y


def cuts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cut positions of texts that lie end to end in ``points`` and begin at ``starts``.

    Only positions with ``CONTEXT`` characters of their own text up to them can be cuts.
    """
    h = tables().gear[points]
    width = 1
    while width < GEAR:
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    ends = np.append(starts[1:], len(points))
    valid = np.ones(len(points), bool)
    for k in range(CONTEXT - 1):
        at = starts + k
        valid[at[at < ends]] = False
    h[~valid] = _TOP
    low = _sliding(h, WINDOW, np.minimum, True)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low[n:] = 0  # windows that stick out of the array are none
    high = _sliding(low, WINDOW, np.maximum, False)
    return np.flatnonzero((high == h) & valid)


def _pieces(docs: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in docs:
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= PIECE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def chunk_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk its text's index, start, length and 64-bit digest."""
    arrays = [code_points(t) for t in texts]
    lengths = np.array([len(a) for a in arrays], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    points = np.concatenate(arrays) if arrays else np.empty(0, np.uint32)
    if not len(points):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = cuts(points, starts)
    doc = np.searchsorted(starts, at, "right") - 1
    same = doc[:-1] == doc[1:]
    first, last, doc = at[:-1][same] - CONTEXT + 1, at[1:][same], doc[:-1][same]
    power, inverse = tables().powers(len(points) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tables().digit[points] * power[: len(points)])])
    digest = _mix((prefix[last + 1] - prefix[first]) * inverse[first])
    return doc, first - starts[doc], last + 1 - first, digest


def _chunks(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = ((i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None and len(t) >= least)
            for ids, texts in _pieces(docs):
                doc, start, length, digest = chunk_digests(texts)
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(np.array(ids, np.int64)[doc]), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["digest", "doc_id", "start", "length"])

    return work


def chunks(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``digest, doc_id, start, length`` of every chunk of texts with at least ``least`` characters."""
    return documents.select(F.col("doc_id").cast("long"), "text").where(F.length("text") >= least).mapInArrow(_chunks(least), "digest long, doc_id long, start int, length int")


def repeated_chunks(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Chunks whose digest occurs in more than one document, with ``n``, how often it occurs at all; durable."""
    if least < CONTEXT + 2 * WINDOW - 1:
        raise ValueError(f"spans shorter than {CONTEXT + 2 * WINDOW - 1} characters need a smaller CONTEXT or WINDOW")
    every = durable(chunks(documents, least), "chunks")
    twice = every.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("digest", "n")
    twice = durable(twice, "repeated")
    return durable(every.join(sized(twice), "digest"), "occurrences")


def _contexts(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences (digest, start, length of one document per row) with the text around them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, occ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for o in occ:
                    s, n = o["start"], o["length"]
                    more = max(0, least - n)
                    left = max(0, s - more)
                    out.append((o["digest"], doc, s, n, s - left, text[left : s + n + more]))
                    if len(out) >= 20_000:
                        yield _context_batch(out)
                        out = []
            if out:
                yield _context_batch(out)

    return work


def _context_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["digest", "doc_id", "start", "length", "before", "around"])


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _compare(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shared spans of the occurrences, which come sorted by digest: each pair of occurrences once."""

    def spans(group: list[tuple]) -> Iterator[tuple]:
        backwards = [g[5][: g[4]][::-1] for g in group]
        after = [g[5][g[4] + g[3] :] for g in group]
        inner = [g[5][g[4] : g[4] + g[3]] for g in group]
        for i, x in enumerate(group):
            for j in range(i + 1, len(group)):
                y = group[j]
                if x[1] == y[1] or inner[i] != inner[j]:
                    continue
                left, right = _common(backwards[i], backwards[j]), _common(after[i], after[j])
                if left + x[3] + right >= least:
                    a, b = (x, y) if x[1] < y[1] else (y, x)
                    yield a[1], b[1], a[2] - left, b[2] - left, left + x[3] + right

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id_a", "doc_id_b", "start_a", "start_b", "length"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    out.extend(spans(group))
                    group = []
                group.append(row)
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
        out.extend(spans(group))
        if out:
            yield batch_of(out)

    return work


def _digests(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two prefix sums of a text, from which the digest of any stretch follows, and the powers to divide by."""
    power, inverse = tables().powers(len(points) + 1)
    zero = np.zeros(1, np.uint64)
    return np.concatenate([zero, np.cumsum(tables().digit[points] * power[: len(points)])]), np.concatenate([zero, np.cumsum(tables().gear[points] * power[: len(points)])]), inverse


def _stretch(sums: tuple[np.ndarray, np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of digest, as two numbers, of the stretches from lo to hi; stretches of other length differ."""
    a, b, inverse = sums
    salt = (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix((a[hi] - a[lo]) * inverse[lo] + salt).view(np.int64), _mix((b[hi] - b[lo]) * inverse[lo] - salt).view(np.int64)


_SURROUND = "digest long, doc_id long, start int, length int, l1 long, l2 long, r1 long, r2 long, c1 long, c2 long"


def _surroundings(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each occurrence the digests of the chunk with half of the missing characters on the left, on the right, and of all that a span can reach."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, occ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                points = code_points(text)
                sums = _digests(points)
                at = {k: np.array([o[k] for o in occ], np.int64) for k in ("digest", "start", "length")}
                lo, hi, size = at["start"], at["start"] + at["length"], len(points)
                more = np.maximum(0, least - at["length"])
                half = (more + 1) // 2
                # a half that the text does not have is in no other text either: the place stands for it
                left, right = lo - half, hi + half
                none = np.full(len(occ), doc, np.int64)
                l1, l2 = _stretch(sums, np.maximum(left, 0), hi)
                r1, r2 = _stretch(sums, lo, np.minimum(right, size))
                l1, l2 = np.where(left < 0, none, l1), np.where(left < 0, -1 - lo, l2)
                r1, r2 = np.where(right > size, none, r1), np.where(right > size, -1 - lo, r2)
                c1, c2 = _stretch(sums, np.maximum(lo - more, 0), np.minimum(hi + more, size))
                # the place of the chunk in its surroundings belongs to the class
                c1 = _mix((c1 + np.minimum(lo, more)).astype(np.uint64)).view(np.int64)
                columns = [at["digest"], none, lo.astype(np.int32), at["length"].astype(np.int32), l1, l2, r1, r2, c1, c2]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _SURROUND.split(", ")])

    return work


_WINDOW = "digest long, c1 long, c2 long, at int, w1 long, w2 long"


def _windows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests of the windows of ``least`` characters around the chunks of the classes that a document stands for; ``at`` counts from the chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, occ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                points = code_points(text)
                sums = _digests(points)
                for o in occ:
                    lo, hi = max(0, min(o["start"], o["start"] + o["length"] - least)), min(max(o["start"], o["start"] + o["length"] - least), len(points) - least)
                    at = np.arange(lo, hi + 1)
                    if len(at):
                        w1, w2 = _stretch(sums, at, at + least)
                        same = [np.full(len(at), o[k], np.int64) for k in ("digest", "c1", "c2")]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array((at - o["start"]).astype(np.int32)), pa.array(w1), pa.array(w2)], names=[f.split()[0] for f in _WINDOW.split(", ")])

    return work


def _with_texts(occurrences: DataFrame, documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text, occ`` of the documents that have occurrences."""
    listed = occurrences.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "start", "length", *more)).alias("occ"))
    return documents.select(F.col("doc_id").cast("long"), "text").join(listed, "doc_id").select("doc_id", "text", "occ")


_CLASS = ["digest", "c1", "c2"]


def shared_classes(many: DataFrame, documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Members and shared windows of the classes of frequent chunks.

    Members: ``digest, c1, c2, doc_id, start``.  Windows: ``digest, c1, c2, at, w1, w2`` and ``lo, hi``, the
    smallest and the largest document that has the window; windows of one document only are left out.
    """
    around = durable(_with_texts(many, documents).mapInArrow(_surroundings(least), _SURROUND), "surroundings")
    halves = around.select("digest", "doc_id", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("l1").alias("h1"), F.col("l2").alias("h2")), F.struct(F.lit(1).alias("side"), F.col("r1").alias("h1"), F.col("r2").alias("h2")))))
    shared = durable(halves.groupBy("digest", "side", "h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("digest", "side", "h1", "h2"), "halves")
    side = lambda k, a, b: sized(shared.where(f"side = {k}").select("digest", F.col("h1").alias(a), F.col("h2").alias(b), F.lit(True).alias(f"has{k}")))
    open_ = around.join(side(0, "l1", "l2"), ["digest", "l1", "l2"], "left").join(side(1, "r1", "r2"), ["digest", "r1", "r2"], "left").where("has0 or has1")
    members = durable(open_.select(*_CLASS, "doc_id", "start", "length"), "members")
    classes = durable(members.groupBy(*_CLASS).agg(F.min(F.struct("doc_id", "start", "length")).alias("m"), F.max("doc_id").alias("hi")).select(*_CLASS, "m.*", "hi"), "class")
    made = durable(_with_texts(classes, documents, "c1", "c2").mapInArrow(_windows(least), _WINDOW), "windows").join(classes.select(*_CLASS, F.col("doc_id").alias("lo"), "hi"), _CLASS)
    held = made.groupBy("digest", "w1", "w2").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first <> last").select("digest", "w1", "w2")
    return members, durable(made.join(held, ["digest", "w1", "w2"]), "shared")


def shared_spans(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """What texts share: spans of document pairs around rarer chunks, and :func:`shared_classes` of the others (None without any).

    The first table has ``doc_id_a < doc_id_b, start_a, start_b, length``: shared spans of
    at least ``least`` characters around chunks with up to ``GROUP`` occurrences.  A long
    shared passage has one row for each of its chunks.

    Null texts and texts below ``least`` characters share nothing.  Ids are taken to be
    unique; a document never pairs with itself.
    """
    found = repeated_chunks(documents, least)
    few, many = found.where(F.col("n") <= GROUP), found.where(F.col("n") > GROUP)
    around = _with_texts(few, documents).mapInArrow(_contexts(least), "digest long, doc_id long, start int, length int, before int, around string")
    spans = around.repartition("digest").sortWithinPartitions("digest").mapInArrow(_compare(least), "doc_id_a long, doc_id_b long, start_a int, start_b int, length int")
    return spans, None if many.isEmpty() else shared_classes(many, documents, least)


def copies(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, rep, n_chars`` of documents whose whole text another document has too; rep is the smallest id of such a class.

    Texts are compared by 128 bits of digest and their length.  Durable.
    """
    text = F.col("text")
    keyed = documents.where(F.length(text) >= least).select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), F.length(text).alias("n_chars"))
    keyed = durable(keyed, "keyed")
    on = ["h1", "h2", "n_chars"]
    classes = keyed.groupBy(*on).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*on, "rep")
    return durable(split_join(keyed, classes, on).select("doc_id", "rep", "n_chars"), "copies")


def distinct_texts(documents: DataFrame, same: DataFrame) -> DataFrame:
    """Documents without those that only repeat another's text."""
    extra = same.where("doc_id <> rep").select("doc_id")
    return documents.join(sized(extra), "doc_id", "left_anti")


def _class_pairs(members: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of the documents that have a window in common; of windows that the same classes have, and of classes with the same documents, one is used."""
    who = members.select(*_CLASS, "doc_id").distinct()
    sets = durable(who.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "doc_id").cast("decimal(20,0)")).alias("s2")), "sets")
    # windows by the sets of documents that have them
    held = windows.select(*_CLASS, "w1", "w2").distinct().join(sets, _CLASS)
    group = held.groupBy("digest", "w1", "w2").agg(F.sum("docs").alias("docs"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2"))
    one = group.groupBy("docs", "t1", "t2").agg(F.min(F.struct("digest", "w1", "w2")).alias("w")).select("w.*")
    chosen = durable(windows.join(sized(durable(one, "chosen")), ["digest", "w1", "w2"]).select("w1", "w2", *_CLASS).distinct().join(who, _CLASS).select("digest", "w1", "w2", "doc_id").distinct(), "holders")
    a, b = (chosen.select("digest", "w1", "w2", F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
    return a.join(b, ["digest", "w1", "w2"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


@kept("pairs")
def shared_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id_a, doc_id_b``, a < b, distinct: documents that share at least ``least`` consecutive characters.

    Whole-text copies are set aside first, so the search sees every text once; the pairs
    found are then given to the copies too, as each pair of documents is a row of the result.
    """
    same = copies(documents, least)
    spans, classes = shared_spans(distinct_texts(documents, same), least)
    pairs = spans.select("doc_id_a", "doc_id_b")
    if classes is not None:
        pairs = pairs.unionByName(_class_pairs(*classes))
    pairs = pairs.distinct()
    if same.isEmpty():
        return pairs
    pairs = durable(pairs, "pairs")
    a, b = same.select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("a")), same.select(F.col("rep").alias("doc_id_b"), F.col("doc_id").alias("b"))
    wide = pairs.join(a, "doc_id_a", "left").join(b, "doc_id_b", "left").select(F.coalesce("a", "doc_id_a").alias("a"), F.coalesce("b", "doc_id_b").alias("b"))
    own = a.join(b, F.col("doc_id_a") == F.col("doc_id_b")).where("a < b").select("a", "b")
    return wide.unionByName(own).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def _islands(rows: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Stretches ``start, length`` of each key that overlap or touch, united."""
    order = Window.partitionBy(*keys).orderBy(start, "length")
    reach = F.max(F.col(start) + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int")).withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_k").agg(F.min(start).alias(start), F.max(F.col(start) + F.col("length")).alias("_end")).select(*keys, start, (F.col("_end") - F.col(start)).alias("length"))


def _passages(documents: DataFrame, same: DataFrame, least: int) -> DataFrame:
    spans, classes = shared_spans(distinct_texts(documents, same), least)
    rows = spans.select(F.inline(F.array(F.struct(F.col("doc_id_a").alias("doc_id"), F.col("start_a").alias("start"), "length"), F.struct(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("start"), "length"))))
    if classes is not None:
        members, windows = classes
        found = _islands(windows.select(*_CLASS, "at", F.lit(least).alias("length")).distinct(), _CLASS, "at")
        rows = rows.unionByName(members.drop("length").join(found, _CLASS).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "length"))
    whole = same.select("doc_id", F.lit(0).alias("start"), F.col("n_chars").alias("length"))
    return _islands(rows.unionByName(whole).distinct(), ["doc_id"], "start")


@kept("passages")
def passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, start, length``: the maximal stretches of each document that lie in spans it shares with another.

    Positions count code points from 0.  The work is linear in the texts however large a
    group of copies is: no pairs of a group are formed beyond ``GROUP`` occurrences.
    """
    return _passages(documents, copies(documents, least), least)


@kept("coverage")
def coverage(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_chars, passages, shared_chars, class_id``: one row per document, how much of it occurs elsewhere.

    class_id is the smallest id among the documents with the very same text, where there are several.
    Null texts count as empty.
    """
    same = copies(documents, least)
    found = _passages(documents, same, least).groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.sum("length").cast("long").alias("shared_chars"))
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    both = rows.join(found, "doc_id", "left").join(same.select("doc_id", F.col("rep").alias("class_id")), "doc_id", "left")
    return both.select("doc_id", "n_chars", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), "class_id")
