"""Removal of repeated passages by a range-partitioned sparse suffix array.

Every byte covered by a SPAN-byte string that also starts in a document with a
smaller doc_id goes. Not all suffixes are sorted, only those that can matter:

1. Anchors. In every SPAN-byte window the GRAM-byte string of least hash is an
   anchor; equal windows have the same anchor at the same place, so windows fall
   into runs by their anchor, one run in about 14 bytes. Anchor hashes are dealt
   into buckets and those of a single document are dropped.
2. Suffixes at the remaining anchors, with what their run's windows cover, are
   range-partitioned by their leading bytes with sampled splitters. Before that
   each task resolves equal runs among its own documents, so that a passage with
   many copies sends a few.
3. Each bucket sorts by multikey quicksort: first the suffixes by their anchor
   string, then, where several documents share it, all windows of those runs.
   Splitters never part equal anchor strings: they are compared on the leading
   bytes that equal strings share, so a string's copies meet in one bucket and
   nothing is left to compare across a boundary but the boundary itself, which
   belongs to the upper bucket.
4. Covered windows return to their documents.

Texts travel compressed and in packs by a hash of doc_id, ids packed, so rows
stay few. Cases: null and short texts lose nothing; matches never cross
documents; repeats within one document stay; rows that share a doc_id are one
text each, neither smaller than the other; a missing doc_id is neither smaller
nor larger than any other, so such rows lose nothing and take nothing; an empty
table gives an empty result; further columns are ignored; very long texts are
taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import slices, texts_of
from chronosift.llm.shingles import mix
from chronosift.session import stored

SPAN, GRAM = 50, 24
#: Places of a gram within a window.
PLACES = SPAN - GRAM + 1
#: Bytes of text per pack of documents, about; bytes hashed at a time; windows compared at a time.
PACK_BYTES, BLOCK, WINDOWS = 12 << 20, 1 << 20, 300_000
SAMPLE = 256
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _load(buf: np.ndarray, n: int, at: int = 0, kind: str = "<u8") -> np.ndarray:
    """The 8-byte words that begin at each of n places."""
    return np.ndarray((n,), kind, buf, at, (1,)).astype(np.uint64)


def _slide(x: np.ndarray, width: int, fn: np.ufunc) -> np.ndarray:
    """fn over every `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = fn(x[:-done], x[done:])
        done *= 2
    return fn(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Anchors:
    """Anchors and runs of documents that stand side by side.

    hash, at: every anchor's gram hash and place in the buffer; runs: anchor
    place, first and last window start of each run, and its document's number.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.buf = np.frombuffer(b"".join(texts) + bytes(SPAN + 32), np.uint8)
        total = int(sizes.sum())
        windows = np.maximum(sizes - SPAN + 1, 0)
        self.doc = np.zeros(0, np.int64)
        self.at = self.first = self.last = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if not windows.sum():
            return
        n = total + SPAN
        words = _load(self.buf, n + 16)
        h = mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + words[16:] * np.uint64(0x165667B19E3779F9))
        least = _slide(h, PLACES, np.minimum)[:total]
        valid = np.zeros(total, bool)
        for at, n_windows in zip(self.begin.tolist(), windows.tolist()):
            valid[at : at + n_windows] = True
        starts = np.flatnonzero(valid)
        shown = np.where(valid, least, 0)
        high = _slide(np.concatenate([np.zeros(PLACES - 1, np.uint64), shown, np.zeros(PLACES, np.uint64)]), PLACES, np.maximum)
        least_in_some = h[: len(high)] == high
        chosen = np.flatnonzero(least_in_some)
        # each window's leftmost least place: the first chosen place in it, or one of the next
        k = (np.cumsum(least_in_some, dtype=np.int32) - least_in_some)[:total][valid]
        want = least[valid]
        wrong = np.flatnonzero(h[chosen][k] != want)
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[h[chosen[k[wrong]]] != want[wrong]]
        # an anchor lies within its window, so windows of two documents have different ones
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        self.at, self.first = chosen[k[cut]], starts[cut]
        self.last = starts[np.append(cut[1:], len(starts)) - 1]
        self.doc = np.searchsorted(self.begin, self.first, "right") - 1
        self.hash = h[self.at]


def _blocks(ids: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BLOCK or i == len(texts) - 1:
            yield np.array(ids[at : i + 1], np.int64), texts[at : i + 1]
            at, held = i + 1, 0


def _pack_of(ids: np.ndarray, packs: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(packs)).astype(np.int64)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 further bits of the hash."""
    high = h >> np.uint64(16)
    return ((high % np.uint64(buckets)) << np.uint64(32)) | ((high // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value, and where it is."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(keys[part[0]]), part


def packed_texts(docs: DataFrame, packs: int) -> DataFrame:
    """(pack, ids, sizes, data): the documents of a task by pack, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            own = np.array(ids, np.int64)
            out = []
            for p, where in _groups(_pack_of(own, packs)):
                part = [texts[i] for i in where.tolist()]
                out.append((p, own[where].tobytes(), np.array([len(t) for t in part], "<i8").tobytes(), squeeze.compress(b"".join(part))))
            cols = list(zip(*out))
            return pa.record_batch([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["pack", "ids", "sizes", "data"])

        for b in slices(batches):
            ids += b.column("doc_id").to_pylist()
            new = [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            texts += new
            held += sum(map(len, new))
            if held >= 2 * PACK_BYTES:
                yield flush()
                ids, texts, held = [], [], 0
        if ids:
            yield flush()

    return texts_of(docs).mapInArrow(run, "pack int, ids binary, sizes binary, data binary")


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents of packed rows in blocks, smallest doc_id first within a row."""
    expand = zstandard.ZstdDecompressor()
    for ids, sizes, data in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "data"))):
        ids, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        raw, ends = expand.decompress(data, max_output_size=int(sizes.sum()) + 1), np.cumsum(sizes).tolist()
        texts = [raw[e - s : e] for s, e in zip(sizes.tolist(), ends)]
        yield from _blocks(ids.tolist(), texts)


def shared_anchors(docs: DataFrame, packs: int, buckets: int) -> DataFrame:
    """(pack, keys, leads): for each pack the keys of anchors that occur in
    several documents, and (pack -1) sampled leading bytes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(1)
        for s in slices(batches):
            keys, parts, leads = [], [], []
            for ids, texts in _blocks(s.column("doc_id").to_pylist(), [t.encode("utf-8", "replace") for t in s.column("text").to_pylist()]):
                a = Anchors(texts)
                if not len(a.at):
                    continue
                k = _keys(a.hash, buckets)
                order = np.lexsort((k, a.doc))
                one = order[np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (a.doc[order][1:] != a.doc[order][:-1])])]
                keys.append(k[one])
                parts.append(_pack_of(ids, packs)[a.doc[one]])
                pick = rng.choice(a.at, min(len(a.at), 16), replace=False)
                leads.append(_load(a.buf, len(a.buf) - 8, 0, ">u8")[pick])
            if not keys:
                continue
            k, p = np.concatenate(keys), np.concatenate(parts)
            rows = [(b, (k[w] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), p[w].astype("<u4").tobytes(), None) for b, w in _groups((k >> np.uint64(32)).astype(np.int64))]
            lead = np.concatenate(leads)[:SAMPLE]
            rows.append((int(k[0] >> np.uint64(32)), b"", b"", (lead ^ np.uint64(1 << 63)).view(np.int64).tolist()))
            c = list(zip(*rows))
            yield pa.record_batch([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.list_(pa.int64()))], names=["bucket", "keys", "packs", "leads"])

    def gather(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table.column("bucket")[0].as_py())
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4")
        parts = np.frombuffer(b"".join(table.column("packs").to_pylist()), "<u4")
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        twice = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        k, p = k[twice], parts[order][twice]
        rows = [(int(x), (np.unique(k[w]).astype(np.uint64) | (bucket << np.uint64(32))).tobytes(), None) for x, w in _groups(p.astype(np.int64))]
        rows += [(-1, None, x) for x in table.column("leads").to_pylist() if x]
        c = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.list_(pa.int64()))], names=["pack", "keys", "leads"])

    sent = texts_of(docs).mapInArrow(send, "bucket int, keys binary, packs binary, leads array<bigint>")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(gather, "pack int, keys binary, leads array<bigint>")


_RUN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("left", "u1"), ("size", "u1")])
ROUTED = "bucket int, runs binary, bytes binary, pack int, spans binary"
_SPANS = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Covered stretches per document, joined where they touch or overlap."""
    order = np.lexsort((start, doc))
    d, s, e = doc[order], start[order], end[order]
    if not len(d):
        return np.zeros(0, _SPANS)
    far = np.maximum.accumulate(e + (np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) << 40))
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > (far[:-1] & ((1 << 40) - 1)))]))
    out = np.zeros(len(cut), _SPANS)
    out["doc"], out["start"] = d[cut], s[cut]
    out["end"] = np.maximum.reduceat(e, cut)
    return out


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of 64-bit words: sort by one word, and only
    what is equal so far goes on to the next. Returns the order, and a flag for
    each place whose row equals the one before."""
    n, depth = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    same = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    for d in range(1, depth):
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~same)[where]
        rows = order[where]
        again = np.lexsort((words[rows, d], group))
        order[where] = rows = rows[again]
        w = words[rows, d]
        same[where[1:]] &= w[1:] == w[:-1]
    return order, same


def _words(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each place as big-endian words (the last may overlap)."""
    flat = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))
    steps = [*range(0, size - 7, 8)]
    if steps[-1] + 8 < size:
        steps.append(size - 8)
    return np.stack([flat[at + s] for s in steps], 1).astype(np.uint64)


def _settled(r: np.ndarray, flat: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Which runs have an equal one in a smaller document, and each run's bytes."""
    size = r["size"].astype(np.int64)
    at = np.cumsum(size) - size
    texts = [flat[b : b + s] for b, s in zip(at.tolist(), size.tolist())]
    docs, lefts, first = r["doc"].tolist(), r["left"].tolist(), {}
    keys = list(zip(texts, lefts))
    for k, d in zip(keys, docs):
        if first.setdefault(k, d) > d:
            first[k] = d
    return np.fromiter(map(first.__getitem__, keys), np.int64, len(keys)) < r["doc"], texts


def route(packed: pa.Table, keys: np.ndarray, splitters: np.ndarray, buckets: int) -> pa.Table:
    """Runs of shared anchors of one pack: those that another document of the
    pack decides become covered spans, the others go to their range's bucket."""
    runs, data, leads, total = [], [], [], 0
    for ids, texts in _texts(packed):
        a = Anchors(texts)
        if not len(a.at):
            continue
        k = _keys(a.hash, buckets)
        i = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        hit = np.flatnonzero(keys[i] == k) if len(keys) else np.zeros(0, int)
        r = np.zeros(len(hit), _RUN)
        r["doc"], r["start"] = ids[a.doc[hit]], a.first[hit] - a.begin[a.doc[hit]]
        r["left"], r["size"] = a.at[hit] - a.first[hit], a.last[hit] + SPAN - a.first[hit]
        size = r["size"].astype(np.int64)
        where = np.repeat(a.first[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        runs.append(r)
        data.append(a.buf[where].tobytes())
        leads.append(_load(a.buf, len(a.buf) - 8, 0, ">u8")[a.at[hit]])
    empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())], names=["bucket", "runs", "bytes", "pack", "spans"])
    if not sum(map(len, runs)):
        return empty
    r, lead = np.concatenate(runs), np.concatenate(leads)
    # equal runs within the pack: only those of the smallest document go on
    covered, texts = _settled(r, b"".join(data))
    pack = packed.column("pack")[0].as_py()
    rows = []
    c = r[covered]
    if len(c):
        rows.append((-1, None, None, pack, _merge(c["doc"], c["start"], c["start"] + c["size"]).tobytes()))
    left, squeeze = np.flatnonzero(~covered), zstandard.ZstdCompressor(level=3)
    for b, w in _groups(np.searchsorted(splitters, lead[left], side="right").astype(np.int64)):
        pick = left[w]
        rows.append((b, squeeze.compress(r[pick].tobytes()), squeeze.compress(b"".join([texts[i] for i in pick.tolist()])), None, None))
    c = list(zip(*rows))
    return pa.table([pa.array(x, t) for x, t in zip(c, (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], names=empty.column_names)


def resolve(table: pa.Table, packs: int) -> pa.Table:
    """One range bucket: sort, compare, and return covered spans by pack."""
    expand = zstandard.ZstdDecompressor()
    plain = lambda c: b"".join(map(expand.decompress, table.column(c).to_pylist()))
    r = np.frombuffer(plain("runs"), _RUN)
    covered, texts = _settled(r, plain("bytes"))
    done = r[covered]
    found: list[np.ndarray] = [_merge(done["doc"], done["start"], done["start"] + done["size"])]
    keep = np.flatnonzero(~covered)
    r, buf = r[keep], np.frombuffer(b"".join([texts[i] for i in keep.tolist()]) + bytes(8), np.uint8)
    del texts
    size = r["size"].astype(np.int64)
    at = np.cumsum(size) - size
    order, same = multikey_order(_words(buf, at + r["left"], GRAM))
    group = np.cumsum(~same) - 1
    starts = np.flatnonzero(~same)
    d = r["doc"][order]
    several = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)
    order, group = order[several[group]], group[several[group]]
    n_windows = size[order] - SPAN + 1
    # whole groups, about WINDOWS windows at a time
    ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1 if len(group) else []
    total = np.cumsum(n_windows)
    begin = 0
    for e in ends:
        if total[e - 1] - (total[begin - 1] if begin else 0) < WINDOWS and e != len(order):
            continue
        rows, n = order[begin:e], n_windows[begin:e]
        begin = e
        run = np.repeat(rows, n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        o, eq = multikey_order(_words(buf, at[run] + offset, SPAN))
        doc = r["doc"][run][o]
        heads = np.flatnonzero(~eq)
        least = np.minimum.reduceat(doc, heads)[np.cumsum(~eq) - 1]
        hit = o[doc > least]
        if len(hit):
            s = r["start"][run[hit]] + offset[hit]
            found.append(_merge(r["doc"][run[hit]], s, s + SPAN))
    spans = np.concatenate(found)
    rows = [(p, spans[w].tobytes()) for p, w in _groups(_pack_of(spans["doc"], packs))]
    c = list(zip(*rows)) if rows else [(), ()]
    return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary())], names=["pack", "spans"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def apply_spans(packed: pa.Table, spans: pa.Table, with_text: bool) -> pa.Table:
    s = np.frombuffer(b"".join(spans.column("spans").to_pylist()), _SPANS) if spans.num_rows else np.zeros(0, _SPANS)
    s = _merge(s["doc"], s["start"], s["end"])
    out = []
    for ids, texts in _texts(packed):
        low, high = np.searchsorted(s["doc"], ids, "left").tolist(), np.searchsorted(s["doc"], ids, "right").tolist()
        for d, t, a, b in zip(ids.tolist(), texts, low, high):
            keep, at = [], 0
            for x, y in zip(s["start"][a:b].tolist(), s["end"][a:b].tolist()):
                keep.append(t[at:x])
                at = y
            kept = b"".join([*keep, t[at:]]) if a < b else t
            out.append((d, len(t), len(t) - len(kept), b - a, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    c = list(zip(*out)) if out else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    t = pa.table([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return t if with_text else t.drop_columns(["kept"])


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    and with_text the remaining bytes."""
    spark = docs.sparkSession
    lone, docs = texts_of(docs.where("doc_id IS NULL")), docs.where("doc_id IS NOT NULL")
    size = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PACK_BYTES))
    shared = stored(shared_anchors(docs, n, n), "shared-anchors")
    cuts = [i / n for i in range(1, n)]
    got = shared.where("pack < 0").select(F.explode("leads").alias("x")).agg(F.percentile_approx("x", cuts, 20_000)).first()[0] if n > 1 else None
    splitters = np.unique(np.array(got or [], np.int64)).view(np.uint64) ^ np.uint64(1 << 63)
    splitters.sort()

    def send(packed: pa.Table, keys: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return route(packed, np.zeros(0, np.uint64), splitters, n)
        k = np.sort(np.frombuffer(b"".join(keys.column("keys").to_pylist()), np.uint64)) if keys.num_rows else np.zeros(0, np.uint64)
        return route(packed, k, splitters, n)

    keys = shared.where("pack >= 0").select("pack", "keys")
    by_pack = lambda df: df.repartition(n, "pack").groupBy("pack")
    routed = stored(by_pack(packed_texts(docs, n)).cogroup(by_pack(keys)).applyInArrow(send, ROUTED), "routed")
    far = routed.where("bucket >= 0").select("bucket", "runs", "bytes").repartition(n, "bucket").groupBy("bucket")
    spans = far.applyInArrow(lambda t: resolve(t, n), "pack int, spans binary").unionByName(routed.where("bucket < 0").select("pack", "spans"))

    def finish(packed: pa.Table, own: pa.Table) -> pa.Table:
        return apply_spans(packed, own, with_text)

    schema = RESULT + (", kept binary" if with_text else "")
    out = by_pack(packed_texts(docs, n)).cogroup(by_pack(spans)).applyInArrow(finish, schema)
    none = F.lit(0).cast("long")
    whole = lone.select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "utf-8").alias("kept"))
    return out.unionByName(whole.select(*out.columns))
