"""Near duplicates by an LSH forest with exact confirmation.

Documents with equal shingle sets form a class, represented by the text of its
smallest doc_id. Each representative has ORDERS signatures of DEPTH minimum hashes. In
each order representatives are sorted by signature; those that share at least
LEAST leading values form a region, and within it a document's neighbours in the
order - those with the longest common prefix - are its candidates. Signatures
have one depth for all regions: a region cut deeper would part similar documents
that share only LEAST values, so dense regions are finished exactly instead (see
below), and depth only ranks the neighbours. Links are confirmed on the full
shingle sets, in steps: close neighbours of the first orders, then all remaining
candidates between different components (within a component a further link
changes nothing).

A region of more than REACH + 1 documents has pairs that are no neighbours. If
such a region still holds several components, it goes on exactly: regions with
common documents form a crowd, and all pairs of a crowd between different
components are compared on their full sets, in salted blocks. So every pair that
shares a region is linked if it is similar enough.

A pair at similarity s is in one region of an order with probability s ** LEAST;
at 0.75 it is in none of the 32 orders with probability 2.4e-8.

Cases: null, empty and white-space texts have the empty set and no links; short
texts are one shingle; exact copies join by their class, never by pairs;
repeated rows are copies, and rows that share a doc_id are one node, linked with
whatever any of their texts is similar to; rows without a doc_id are never
linked: they are kept with a null component; an empty table gives an empty
result; further columns are ignored; very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import arrow_map, slices, texts_of
from chronosift.llm.components import components
from chronosift.llm.shingles import shingle_sets
from chronosift.session import stored

WORDS = 5
#: Similarity threshold as a fraction of whole numbers: 100 * |A n B| >= 75 * |A u B|.
PERCENT = 75
ORDERS, DEPTH, LEAST = 32, 5, 3
#: Farthest neighbours in an order. Steps of confirmation: (orders, distance) up to which candidates are due.
REACH = 4
STEPS = ((2, 1), (ORDERS, REACH))
#: Documents and shingles in a block of a crowd, about; shingles compared at a time.
BLOCK_ROWS, BLOCK_ITEMS, SLAB = 1000, 1 << 20, 4096

_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**63, ORDERS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, ORDERS * DEPTH, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, ORDERS * DEPTH) minimum hashes as big-endian 32-bit integers; every set has an element."""
    flat = np.concatenate(sets)
    starts = np.cumsum([len(s) for s in sets]) - [len(s) for s in sets]
    out = np.empty((len(sets), len(_MUL)), ">u4")
    for k, (m, a) in enumerate(zip(_MUL, _ADD)):
        out[:, k] = np.minimum.reduceat((flat * m + a) >> np.uint64(32), starts)
    return out


def fingerprint(items: np.ndarray) -> bytes:
    """128 bits of a sorted shingle set."""
    return hashlib.blake2b(items.astype("<u8").tobytes(), digest_size=16).digest()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (fingerprint of the set), sig (null for empty sets)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column("text").to_pylist(), WORDS)
        full = [s for s in sets if len(s)]
        sigs = iter(signatures(full)) if full else iter(())
        sig = [next(sigs).tobytes() if len(s) else None for s in sets]
        fp = [fingerprint(s) for s in sets]
        return pa.record_batch(
            [b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
            names=["doc_id", "n_shingles", "fp", "sig"],
        )

    return arrow_map(texts_of(docs), run, "doc_id long, n_shingles long, fp binary, sig binary")


def _pairs(rows: list[tuple], row: tuple, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """Candidates of a row with those before it in its region: order, distance,
    ids. The smaller set must have PERCENT of the larger one's size."""
    order, key, doc, n = row
    for d, (o, k, other, m) in enumerate(reversed(rows), 1):
        if d > reach or o != order or k[: 4 * LEAST] != key[: 4 * LEAST]:
            return
        if 100 * min(m, n) >= PERCENT * max(m, n):
            yield order, d, min(doc, other), max(doc, other)


def candidates(reps: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(ord, dist, a, b) of neighbours in the sorted orders, and (ord, region,
    doc_id, n_shingles) of all rows in regions that may hold more than REACH + 1;
    reps: doc_id, sig, n_shingles."""
    width, shared = 4 * DEPTH, 4 * LEAST

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("doc_id").to_numpy()
        flat = b"".join(b.column("sig").to_pylist())
        keys = [flat[at : at + width] for at in range(0, len(flat), width)]
        return pa.record_batch(
            [pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(ids))), pa.array(keys, pa.binary()), pa.array(np.repeat(ids, ORDERS)), pa.array(np.repeat(b.column("n_shingles").to_numpy(), ORDERS))],
            names=["ord", "key", "doc_id", "n"],
        )

    rows = arrow_map(reps.select("doc_id", "sig", "n_shingles"), spread, "ord int, key binary, doc_id long, n long", "sig")
    dealt = rows.repartitionByRange(parts, "ord", "key", "doc_id").sortWithinPartitions("ord", "key", "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates within the partition, its edge rows (dist 0: first, -1: last) and the rows of its crowded regions (dist -2)."""
        last: deque = deque(maxlen=REACH)
        seen = 0
        region, held, crowded = None, [], False
        for b in batches:
            out, edges = [], []
            for row in zip(b.column("ord").to_pylist(), b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("n").to_pylist()):
                if last and last[-1][1][: 4 * LEAST] == row[1][: 4 * LEAST]:
                    out += _pairs(last, row, REACH)
                if seen < REACH:
                    edges.append((row[0], 0, row[2], row[3], row[1]))
                if region != (row[0], row[1][:shared]):
                    # the first and the last region of a partition may go on in another
                    crowded, held, region = region is None, [], (row[0], row[1][:shared])
                (edges if crowded else held).append((row[0], -2, row[2], row[3], row[1][:shared]))
                if len(held) > REACH + 1:
                    edges += held
                    crowded, held = True, []
                last.append(row)
                seen += 1
            yield _batch([(*p, None) for p in out] + edges)
        yield _batch([(o, -1, d, n, k) for o, k, d, n in last] + held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        o, d, a, b, k = zip(*rows) if rows else ((), (), (), (), ())
        return pa.record_batch([pa.array(o, pa.int32()), pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.binary())], names=["ord", "dist", "a", "b", "key"])

    found = stored(dealt.mapInArrow(scan, "ord int, dist int, a long, b long, key binary"), "candidates")
    # regions that two partitions share: a few edge rows of each partition
    edges = sorted({(r.ord, bytes(r.key), r.a, r.b) for r in found.where("dist in (0, -1)").collect()})
    more = [p for i, row in enumerate(edges) for p in _pairs(edges[max(0, i - REACH) : i], row, REACH)]
    across = found.sparkSession.createDataFrame(more, "ord int, dist int, a long, b long")
    members = found.where("dist = -2").select("ord", F.col("key").alias("region"), F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return found.where("dist > 0").select("ord", "dist", "a", "b").unionByName(across), members


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough on their full sets (doc_id, items)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column("items_a").to_pylist(), b.column("items_b").to_pylist()):
            p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(p) + len(q) - common))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(both, run, "a long, b long", "items_a")


def _links(t: pa.Table) -> pa.Table:
    """Similar pairs of two blocks of a crowd, enough of them to join the components that any pair joins."""
    ids, block = t.column("doc_id").to_numpy(), t.column("block").to_numpy()
    _, comp = np.unique(t.column("component").to_numpy(), return_inverse=True)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    out: list[tuple[int, int]] = []
    if comp.any() and block.min() == t.column("i")[0].as_py() and block.max() == t.column("j")[0].as_py():
        sets = [np.frombuffer(x, "<u8") for x in t.column("items").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(sets)), n), times > 1
        row, item = row[often[item]], (np.cumsum(often) - 1)[item[often[item]]]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(often.sum()), SLAB):
            lo, hi = np.searchsorted(item, [at, at + SLAB])
            has = np.zeros((len(sets), SLAB), np.float32)
            has[row[lo:hi], item[lo:hi] - at] = 1
            common += has[left] @ has[right].T
        both = common.astype(np.int64)
        near = (100 * both >= PERCENT * (n[left][:, None] + n[right] - both)) & (comp[left][:, None] != comp[right])
        p, q = (side[at] for side, at in zip((left, right), np.nonzero(near)))
        _, first = np.unique(np.minimum(comp[p], comp[q]) * len(sets) + np.maximum(comp[p], comp[q]), return_index=True)
        top = list(range(len(sets)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for x, y in zip(p[first].tolist(), q[first].tolist()):
            u, v = find(int(comp[x])), find(int(comp[y]))
            if u != v:
                top[u] = v
                out.append((int(ids[x]), int(ids[y])))
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def crowd_links(members: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) between the components (id, component) that a crowded region
    holds; None where each such region is within one component."""
    of = comp.select(F.col("id").alias("doc_id"), "component")
    m = stored(members.join(of.hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "crowded")
    by = ["ord", "region"]
    regions = m.groupBy(by).agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("first"))
    regions = stored(regions.where(f"n > {REACH + 1} and lo < hi").select(*by, "first"), "regions")
    if not regions.head(1):
        return None
    group = components(m.join(regions.hint("merge"), by).select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    rows = m.select("doc_id", "component", "n_shingles").distinct().join(group.select(F.col("id").alias("doc_id"), F.col("component").alias("crowd")).hint("merge"), "doc_id")
    rows = stored(rows, "crowds")
    # the largest component of a crowd meets only the rest: its own pairs are linked already
    size = rows.groupBy("crowd", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
    need = lambda n, items: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(items / BLOCK_ITEMS))
    plan = size.groupBy("crowd").agg(F.max(F.struct("n", "component", "items")).alias("main"), F.sum("n").alias("n"), F.sum("items").alias("items"))
    plan = plan.select("crowd", F.col("main.component").alias("main"), need(F.col("main.n"), F.col("main.items")).alias("mains"), need(F.col("n") - F.col("main.n"), F.col("items") - F.col("main.items")).alias("rests"))
    plan = stored(plan, "crowd-plan")  # so that the join can split a large crowd
    is_main, salt = F.col("component") == F.col("main"), F.xxhash64("doc_id")
    rows = rows.join(plan.hint("merge"), "crowd").where("rests > 0").withColumn("block", F.when(is_main, F.pmod(salt, F.col("mains"))).otherwise(F.col("mains") + F.pmod(salt, F.col("rests"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rests") - 1)))
    rows = rows.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component")
    return rows.hint("merge").join(sets, "doc_id").groupBy("crowd", "i", "j").applyInArrow(_links, "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    spark = docs.sparkSession
    f = stored(features(docs), "features")
    known = f.where("n_shingles > 0 and doc_id is not null")
    # a class has a number of its own: a doc_id may have several texts
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cand, members = candidates(classes.select(F.col("node").alias("doc_id"), "sig", "n_shingles"), parts)
    cand = stored(cand.groupBy("a", "b").agg(F.min("ord").alias("ord"), F.min("dist").alias("dist")).where("a != b"), "pairs")
    ids = cand.select(F.col("a").alias("node")).union(cand.select("b")).union(members.select("doc_id")).distinct()
    asked = classes.select("node", "fp", "rep").join(ids.hint("merge"), "node", "left_semi")

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column("text").to_pylist(), WORDS)
        return pa.record_batch([pa.array(map(fingerprint, sets), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["fp", "items"])

    # what grows with the corpus is merged, here and below: broadcasts pass through the driver
    texts = texts_of(docs).join(asked.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = arrow_map(texts, make, "fp binary, items binary").join(asked.select("fp", "node").hint("merge"), "fp")
    sets = stored(sets.select(F.col("node").alias("doc_id"), "items").dropDuplicates(["doc_id"]), "sets")
    # classes that share a doc_id are joined by it
    same = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("doc_id")
    same = known.select("doc_id", "fp").distinct().join(same.hint("merge"), "doc_id", "left_semi").join(classes.select("fp", "node").hint("merge"), "fp")
    same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("b")).hint("merge"), "doc_id").select(F.col("node").alias("a"), "b").where("a != b")
    links = comp = None
    due = F.lit(False)
    for orders, reach in STEPS:
        now = (F.col("ord") < orders) & (F.col("dist") <= reach)
        rest = cand.where(now & ~due).select("a", "b")
        due = due | now
        if comp is not None:
            of = lambda side: comp.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")).hint("merge")  # noqa: B023, E731
            rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        new = confirmed(rest, sets)
        new = stored(new if comp is not None else new.unionByName(same), "confirmed")
        # what is connected already needs no more than its star
        links = new if comp is None else new.unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
        comp = stored(components(links), "components")
    more = crowd_links(members, comp, sets)
    if more is not None:
        links = stored(more, "confirmed").unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
        comp = stored(components(links), "components")
    owner = classes.select("fp", "rep", F.col("node").alias("id")).join(comp.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = owner.groupBy("component").agg(F.min("rep").alias("component_id"))
    owner = owner.join(smallest.hint("merge"), "component").select("fp", "component_id")
    out = f.join(owner.hint("merge"), "fp", "left")
    c = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    c = F.when(F.col("doc_id").isNotNull(), c)
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.col("doc_id").eqNullSafe(c).alias("kept"))
