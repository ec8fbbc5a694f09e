"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are reduced to their lower-cased letters and digits
(a compact form; spaces, punctuation and case cannot hide a copy). An item is a
set of patterns: its whole compact form if short, else overlapping pieces of
PATTERN bytes. A pattern of length m occurs within e edits, e = m * EDIT_PERCENT
/ 100, only where a diagonal band holds at least m - q + 1 - q * e shared q-grams
(the lemma). Patterns too short for that bound with q = Q have shorter grams, so
every pattern has a bound of one at least; patterns of one q share an index. Bands of the document's diagonals overlap by half, so that every
occurrence lies within one; bands that meet the bound are retained, and verified
by an alignment banded to the diagonals of the region.

The benchmark is a small table and is shipped with the tasks; its size is checked
against MAX_BENCHMARK_BYTES, beyond which it is taken in blocks, one pass each,
so that any benchmark works and no broadcast grows.

Cases: null and empty texts are clean; items without letters or digits are
ignored; of ties the smallest item_id is named; repeated items and rows, also of
one doc_id, and null ids are each handled alone and give the same result; empty
tables give clean documents; very long texts are scanned whole; further columns
are ignored. A verbatim part of an item is found wherever it holds a whole
pattern, which any PATTERN + PATTERN_STEP compact bytes of a long item do; less
than that, or part of an item shorter than PATTERN, is no contamination.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import arrow_map, texts_of
from chronosift.session import stored

Q = 8
EDIT_PERCENT = 8
PATTERN, PATTERN_STEP = 96, 48
#: Compact benchmark bytes of one pass.
MAX_BENCHMARK_BYTES = 8 << 20
#: Matches of q-grams taken at a time, and diagonals aligned at a time.
PAIRS, REGION = 2 << 20, 1 << 20
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())


def compact(text: str) -> bytes:
    """Lower-cased text in UTF-8 without ASCII other than letters and digits."""
    return text.lower().encode("utf-8", "replace").translate(None, _DROP)


def patterns_of(data: bytes) -> list[bytes]:
    """A whole short item, or overlapping pieces that cover a long one."""
    if len(data) <= PATTERN:
        return [data] if data else []
    starts = [*range(0, len(data) - PATTERN, PATTERN_STEP), len(data) - PATTERN]
    return [data[s : s + PATTERN] for s in starts]


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """All q-grams (q up to 8) as 64-bit integers."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    wide = np.ndarray((len(data) - q + 1,), "<u8", data.tobytes() + bytes(8), 0, (1,)).astype(np.uint64)
    return wide & np.uint64((1 << 8 * q) - 1)


def budget(m: int) -> int:
    return m * EDIT_PERCENT // 100


def gram_size(m: int) -> int:
    """Q, or less where the lemma's bound needs it."""
    return min(Q, m // (budget(m) + 1))


def bound(m: int) -> int:
    """Shared q-grams that an occurrence within the budget has at least."""
    q = gram_size(m)
    return m - q + 1 - q * budget(m)


def banded(pattern: np.ndarray, region: np.ndarray, e: int) -> tuple[int, int]:
    """Least edits (up to e + 1) with which the pattern occurs in a region whose
    first e .. len(region) - m + e diagonals count, and the end of that
    occurrence in the region. Row by row over the band; insertions along a row
    are a running minimum."""
    m, n = len(pattern), len(region)
    low, high = -e, n - m + e  # diagonals: place in the region less place in the pattern
    width = high - low + 1
    big = m + n
    j = np.arange(low, high + 1)
    row = np.where((j >= 0) & (j <= n), 0, big)  # the occurrence may begin anywhere
    steps = np.arange(width)
    padded = np.concatenate([np.full(m + e + 1, -1), region, np.full(m + 2 * e + 2, -2)]).astype(np.int64)
    shift = m + e + 1
    for i in range(1, m + 1):
        at = i + j
        same = padded[shift + at - 1] == pattern[i - 1]
        new = row + ~same
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((at >= 0) & (at <= n), new, big)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > e:
            return e + 1, 0
    best = int(row.argmin())
    return int(row[best]), int(min(n, m + low + best))


class Index:
    """What is looked for: patterns by the size of their grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        least: dict[bytes, int] = {}
        for item, data in items:
            for p in patterns_of(data):
                least[p] = min(item, least.get(p, item))
        self.parts = [_Part(q, [(i, p) for p, i in least.items() if gram_size(len(p)) == q]) for q in sorted({gram_size(len(p)) for p in least})]
        # a pattern that several items share stands for all of them
        self.sharing: dict[bytes, list[int]] = {}
        for item, data in items:
            for p in set(patterns_of(data)):
                self.sharing.setdefault(p, []).append(item)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, edits, end of the occurrence in the compact form), the least edits of each item."""
        data = compact(text)
        best: dict[int, tuple[int, int]] = {}
        doc = np.frombuffer(data, np.uint8)
        for part in self.parts:
            for pattern, edits, end in part.matches(doc):
                for item in self.sharing[pattern]:
                    best[item] = min(best.get(item, (99999, 0)), (edits, end))
        return sorted((i, e, at) for i, (e, at) in best.items())


class _Part:
    """The q-grams of all patterns of one q."""

    def __init__(self, q: int, patterns: list[tuple[int, bytes]]):
        self.q = q
        self.raw = [p for _, p in patterns]
        self.patterns = [np.frombuffer(p, np.uint8) for p in self.raw]
        own = [grams(p, q) for p in self.patterns]
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        self.grams = flat[order]
        self.pattern_of = np.repeat(np.arange(len(own)), [len(g) for g in own])[order]
        self.place_of = np.concatenate([np.arange(len(g)) for g in own])[order]
        # a table of bits by hash: most of a document's q-grams stop here
        self.bits = 22
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._hash(self.grams)] = True
        self.e = np.array([budget(len(p)) for p in self.patterns])
        self.bound = np.array([bound(len(p)) for p in self.patterns])
        self.length = np.array([len(p) for p in self.patterns])

    def _hash(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def matches(self, doc: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        """(pattern, edits, end) of occurrences within the budget."""
        for pattern, diagonal, span in self._regions(doc):
            m, e = int(self.length[pattern]), int(self.e[pattern])
            start = max(0, diagonal - e)
            region = doc[start : diagonal + span + m + e]
            if len(region) < m - e:
                continue
            edits, end = banded(self.patterns[pattern], region, e)
            if edits <= e:
                yield self.raw[pattern], edits, start + end

    def _bands(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of a band (pattern * top + first) and the document's places
        with a shared q-gram in it, for bands that have one. Places are taken
        PAIRS matches at a time, and a gram that repeats in a pattern counts
        once per band at once, so long runs of one character stay small."""
        at = np.flatnonzero(self.table[self._hash(g)])
        low = np.searchsorted(self.grams, g[at], "left")
        n = np.searchsorted(self.grams, g[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        top = (len(g) + 2 * PATTERN) // (int(self.e.min()) + 1) + 3
        total, begin, found = np.cumsum(n), 0, []
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            own, first_of, k = at[begin:end], low[begin:end], n[begin:end]
            begin = end
            which = np.repeat(first_of - (np.cumsum(k) - k), k) + np.arange(k.sum())
            pattern, nth = self.pattern_of[which], np.repeat(np.arange(len(own)), k)
            # an occurrence spans e + 1 diagonals; bands of twice as many begin every e + 1
            band = pattern * top + (own[nth] - self.place_of[which] + PATTERN) // (self.e[pattern] + 1)
            # the places of a gram in one pattern stand together, with falling diagonals
            fresh = np.concatenate([[True], (band[1:] != band[:-1]) | (nth[1:] != nth[:-1])])
            band, nth = band[fresh], nth[fresh]
            # a shared q-gram counts in the two bands that hold its diagonal; one place of the document counts once per band
            band = np.concatenate([band, np.where(band % top > 0, band - 1, band)])
            pair = np.unique(band * len(own) + np.concatenate([nth, nth]))
            found.append(np.unique(pair // len(own), return_counts=True))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), top
        band, of = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
        count = np.zeros(len(band), np.int64)
        np.add.at(count, of, np.concatenate([c for _, c in found]))
        return band, count, top

    def _regions(self, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(pattern, first diagonal, diagonals) of the bands that meet the
        bound; neighbouring ones are one region."""
        band, count, top = self._bands(grams(doc, self.q))
        band = band[count >= self.bound[band // top]]
        at = 0
        while at < len(band):
            k = int(band[at] // top)
            w = int(self.e[k]) + 1
            end = at + 1
            while end < len(band) and band[end] == band[end - 1] + 1 and band[end] // top == k and (end - at) * w < REGION:
                end += 1
            yield k, int(band[at] % top) * w - PATTERN, (end - at + 1) * w
            at = end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of bounded size, in item order."""
    block, held = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id").toLocalIterator():
        data = compact(r.text)
        block.append((r.item_id, data))
        held += len(data)
        if held >= MAX_BENCHMARK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id (least edits, then smallest id; null if
    clean), edits, n_items (benchmark items found in the text)."""
    blocks, passes = _blocks(benchmark), []
    first, second = next(blocks, None), next(blocks, None)
    rows = texts_of(docs)
    if second:  # each pass sees other items, and a row's results meet by a number of its own
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    for items in chain([first] if first else [], [second] if second else [], blocks):
        index = Index(items)

        def run(b: pa.RecordBatch, index: Index = index, numbered: bool = second is not None) -> pa.RecordBatch:
            found = [index.matches(t) for t in b.column("text").to_pylist()]
            top = [min(((e, i) for i, e, _ in f), default=(None, None)) for f in found]
            columns = {
                "doc_id": b.column("doc_id").cast(pa.int64()), "item_id": pa.array([i for _, i in top], pa.int64()),
                "edits": pa.array([e for e, _ in top], pa.int64()), "n_items": pa.array(map(len, found), pa.int64()),
            }
            return pa.record_batch(columns | ({"row": b.column("row")} if numbered else {}))

        passes.append(arrow_map(rows, run, "doc_id long, item_id long, edits long, n_items long" + (", row long" if second else "")))
    if not passes:
        return docs.select(F.col("doc_id").cast("long"), F.lit(False).alias("contaminated"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("edits"), F.lit(0).cast("long").alias("n_items"))
    if len(passes) == 1:
        out = passes[0]
    else:
        best = F.min(F.when(F.col("item_id").isNotNull(), F.struct("edits", "item_id")))
        out = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.max("doc_id").alias("doc_id"), best.alias("best"), F.sum("n_items").alias("n_items"))
        out = out.select("doc_id", "best.item_id", "best.edits", "n_items")
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "edits", "n_items")
