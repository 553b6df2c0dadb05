"""Passages of held-out test items inside training documents.

1. An item gets SimHashes of its windows of shingles: of all windows of ``run`` words, the
   shortest passage that counts, and of the windows of nearly its own size (sizes lie on
   a ladder, each a quarter above the last, so few sizes serve items of any length).
   Every window of those sizes of a document gets one too.
2. Multi-index Hamming search: a fingerprint is cut into four blocks of 16 bits.  If blocks
   may differ in r1 to r4 bits and ``r1 + r2 + r3 + r4 + 4 > radius``, two fingerprints
   within the radius agree that far in one block at least; so each item block is entered
   under all its neighbours of that distance, and looking four blocks up finds all pairs.
3. Candidates are verified by the exact weighted Jaccard similarity of their shingles (a
   shingle weighs as often as it occurs in the window), and the longest run of equal
   words is measured on the words themselves.

A document that holds ``run`` words of an item has a window with the very shingles, and the
very fingerprint, of a window of the item: exact runs are never missed.  Windows of an
item's size find whole items with some words changed; there the radius decides the recall.

Documents are scanned where they lie and nothing is shuffled but the hits.  Items are a
stated query set: their windows are sent along, ``ITEM_WINDOWS`` at a time, and a larger
set takes several scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of windows of an item's size may differ.  At a similarity of 0.8 the expected number is
#: 64 * acos(8 / 9) / pi = 9.7 with a deviation of 2.9, so 13 keeps 90 % even there, and more above.
RADIUS = 13
#: Window sizes grow by this factor.
STEP = 1.25
#: Windows of items that one scan of the documents looks for: some 150 MB in each worker, as an eighth of them or so
#: is entered under all neighbours.
ITEM_WINDOWS = 50_000
#: Words handled at a time.
PIECE = 65_536

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile("[İΣ]")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of Unicode letters or digits, each lower-cased by itself."""
    if not text:
        return []
    if _ODD.search(text):  # their lower case is longer or depends on neighbours
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class Codes(dict):
    """64-bit codes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit codes of all runs of ``size`` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, size):
        h = h * _MUL + codes[k : k + n]
    return _mix(h)


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers per bit position; a number's binary digits are whole arrays of 64 positions each."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x = a[k] if k < len(a) else None
        y = b[k] if k < len(b) else None
        if x is None or y is None:
            z = y if x is None else x
            out.append(z if carry is None else z ^ carry)
            carry = None if carry is None else z & carry
        elif carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return out if carry is None else [*out, carry]


class Sums:
    """Counts of set bits over runs of 1, 2, 4, ... consecutive codes, for 64 bits at once, shared by all window sizes."""

    def __init__(self, codes: np.ndarray, most: int) -> None:
        self.codes, self.powers, width = codes, [[codes]], 1
        while 2 * width <= min(most, len(codes)):
            last = self.powers[-1]
            self.powers.append(_add([p[:-width] for p in last], [p[width:] for p in last]))
            width *= 2

    def majority(self, count: int) -> np.ndarray:
        """SimHash of every ``count`` consecutive codes: a bit is set if most of them have it."""
        n = len(self.codes) - count + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total: list[np.ndarray] = []
        done = 0
        for k, power in enumerate(self.powers):
            if count >> k & 1:
                part = [p[done : done + n] for p in power]
                total = part if not total else _add(total, part)
                done += 1 << k
        more, equal = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
        for k in range(len(total) - 1, -1, -1):
            if (count // 2) >> k & 1:
                equal = equal & total[k]
            else:
                more |= equal & total[k]
                equal = equal & ~total[k]
        return more


def fingerprints(codes: np.ndarray, count: int) -> np.ndarray:
    """SimHash of every ``count`` consecutive shingle codes."""
    return Sums(codes, count).majority(count)


def ladder(run: int, longest: int) -> list[int]:
    """Window sizes from ``run`` up to ``longest`` words."""
    sizes = [run]
    while (more := int(np.ceil(sizes[-1] * STEP))) <= longest:
        sizes.append(more)
    return sizes


class Level:
    """Fingerprints of the items' windows of one size, and the index that finds those near to a given one."""

    BLOCKS, BITS = 4, 16

    def __init__(self, size: int, radius: int, prints: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        self.size, self.radius, self.prints, self.item, self.at = size, radius, prints, item, at
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def _build(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block the windows by key, each under all keys that differ in few bits; made where it is used."""
        spare = self.radius + 1 - self.BLOCKS  # bits that may differ in the blocks beyond one each
        tables = []
        for b in range(self.BLOCKS):
            far = spare // self.BLOCKS + (b < spare % self.BLOCKS)
            masks = np.array([sum(1 << b for b in bits) for k in range(far + 1) for bits in combinations(range(self.BITS), k)], np.int64)
            keys = (self._block(self.prints, b)[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << self.BITS))]).astype(np.int64)
            tables.append((first, (order // len(masks)).astype(np.int32)))
        return tables

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.BITS) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a given fingerprint and an item window within the radius, each once."""
        if self.tables is None:
            self.tables = self._build()
        mine, theirs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b, (first, windows) in enumerate(self.tables):
            key = self._block(prints, b)
            begin = first[key]
            many = first[key + 1] - begin
            hit = np.flatnonzero(many)
            for rows in np.array_split(hit, max(1, int(many[hit].sum()) // 100_000)):  # pieces that fit a core's cache
                n = many[rows]
                end = np.cumsum(n)
                window = windows[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[rows] - end + n, n)]
                close = np.flatnonzero(np.bitwise_count(np.repeat(prints[rows], n) ^ self.prints[window]) <= self.radius)
                mine.append(rows[np.searchsorted(end, close, "right")])
                theirs.append(window[close].astype(np.int64))
        pairs = np.unique(np.concatenate(mine) * max(1, len(self.prints)) + np.concatenate(theirs))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class ItemIndex:
    """The windows of a set of items, by size."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, radius: int = RADIUS, shingle: int = SHINGLE) -> None:
        self.run, self.shingle = run, shingle
        codes = Codes()
        every = [words(t) for _, t in items]
        keep = [k for k, ws in enumerate(every) if len(ws) >= run]
        self.ids = np.array([items[k][0] for k in keep], np.int64)
        self.words = [every[k] for k in keep]
        made = [shingles(np.array([codes[w] for w in ws], np.uint64), shingle) for ws in self.words]
        self.flat, self.start = np.concatenate([*made, np.empty(0, np.uint64)]), np.cumsum([0, *map(len, made)])
        sizes = ladder(run, max(map(len, self.words), default=run))
        own = [max(s for s in sizes if s <= len(ws)) for ws in self.words]
        self.levels = []
        for size in sizes:
            members = [k for k in range(len(keep)) if size in (run, own[k])]
            prints = [fingerprints(made[k], size - shingle + 1) for k in members]
            if members:  # windows of the shortest size are only looked for as they are: any other shingle costs them 0.2 of similarity or more
                item = np.repeat(np.array(members, np.int64), [len(p) for p in prints])
                self.levels.append(Level(size, Level.BLOCKS - 1 if size == run else radius, np.concatenate(prints), item, np.concatenate([np.arange(len(p)) for p in prints])))


def _numbered(rows: np.ndarray) -> np.ndarray:
    """Rows of codes sorted, with the k-th copy of a code told from the others, so that bags become sets."""
    rows = np.sort(rows, axis=1)
    same = rows[:, 1:] == rows[:, :-1]
    if same.any():
        copy = np.zeros(len(rows), np.uint64)
        numbers = np.zeros(rows.shape, np.uint64)
        for k in range(same.shape[1]):
            copy = (copy + np.uint64(1)) * same[:, k]
            numbers[:, k + 1] = copy
        rows = np.where(numbers > 0, _mix(rows + numbers * _MUL), rows)
    return rows


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the bags in each row of a and b: shared over all, each shingle as often as it occurs."""
    both = np.sort(np.concatenate([_numbered(a), _numbered(b)], axis=1), axis=1)
    shared = (both[:, 1:] == both[:, :-1]).sum(axis=1)
    return shared / (both.shape[1] - shared)


_FOUND = "doc_id long, item_id long, similarity double, window_words int, windows int, run_words int"


def _scan(index: ItemIndex, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hits(docs: list[int], lists: list[list[str]], flat: np.ndarray) -> list[tuple]:
        begin = np.cumsum([0, *map(len, lists)])
        codes = shingles(flat, index.shingle)
        sums = Sums(codes, max(level.size for level in index.levels))
        best: dict[tuple[int, int], list] = {}
        runs: dict[tuple[int, int], dict[int, list[int]]] = {}
        for level in index.levels:
            count = level.size - index.shingle + 1
            rows, windows = level.near(sums.majority(count))
            doc = np.searchsorted(begin, rows, "right") - 1
            inside = rows + level.size <= begin[doc + 1]
            rows, windows, doc = rows[inside], windows[inside], doc[inside]
            item, at, span = level.item[windows], level.at[windows], np.arange(count)
            sims = np.empty(len(rows))
            for k in range(0, len(rows), 20_000):
                part = slice(k, k + 20_000)
                sims[part] = similarities(codes[rows[part, None] + span], index.flat[index.start[item[part]][:, None] + at[part, None] + span])
            good = np.flatnonzero(sims >= least)
            for r, d, k, w, sim in zip(rows[good].tolist(), doc[good].tolist(), item[good].tolist(), at[good].tolist(), sims[good].tolist()):
                found = best.setdefault((d, k), [0, 0.0, 0])
                found[:2] = max((found[0], found[1]), (level.size, sim))
                found[2] += 1
                own = r - int(begin[d])
                if level.size == index.run and lists[d][own : own + index.run] == index.words[k][w : w + index.run]:
                    runs.setdefault((d, k), {}).setdefault(own - w, []).append(own)
        out = []
        for (d, item), (size, sim, n) in best.items():
            longest = 0
            for starts in runs.get((d, item), {}).values():
                length, last = 0, None
                for s in sorted(starts):
                    length = length + 1 if last == s - 1 else index.run
                    longest, last = max(longest, length), s
            out.append((docs[d], int(index.ids[item]), sim, size, n, longest))
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codes().__getitem__
        for batch in batches:
            docs, lists, size = [], [], 0
            out: list[tuple] = []

            def flush() -> None:
                flat = np.fromiter((code(w) for ws in lists for w in ws), np.uint64, size)
                out.extend(hits(docs, lists, flat))

            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(t)
                if len(ws) < index.run or not index.levels:
                    continue
                docs.append(i)
                lists.append(ws)
                size += len(ws)
                if size >= PIECE:
                    flush()
                    docs, lists, size = [], [], 0
            if docs:
                flush()
            if out:
                yield batch_of(out)

    return work


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, least: float = SIMILARITY, radius: int = RADIUS, item_windows: int = ITEM_WINDOWS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, item_id, similarity, window_words, windows, run_words``: documents with a passage like one of an item.

    window_words is the largest window size at which the passages reach ``least``, similarity the
    best at that size, windows the number of window pairs that reach it, run_words the longest
    run of equal words (0 if below ``run``).  Items or texts with fewer than ``run`` words,
    empty or null, match nothing.  Repeated item rows count once.
    """
    size = F.greatest(F.lit(0), F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) - run + 1)
    distinct = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    total = distinct.agg(F.sum(size)).first()[0]
    scans = max(1, -(-int(total or 0) // item_windows))
    found = None
    for k in range(scans):
        some = distinct if scans == 1 else distinct.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == k)
        index = ItemIndex([(r.item_id, r.text) for r in some.toLocalIterator()], run, radius, shingle)
        part = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(index, least), _FOUND)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("window_words", "similarity")).alias("b")
    grouped = found.groupBy("doc_id", "item_id").agg(best, F.sum("windows").alias("windows"), F.max("run_words").alias("run_words"))
    return grouped.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), F.col("b.window_words").alias("window_words"), "windows", "run_words")
