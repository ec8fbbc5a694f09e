"""Token ids in a bit-packed file format.

A file is a Parquet table of blocks; a block holds consecutive documents in
ascending doc_id order:

    part, block     place of the block in the corpus
    n_docs, n_ids   documents and ids of the block
    bits            width of an id: the minimum for the vocabulary
    low, high       smallest and largest doc_id of the block
    doc_ids         little-endian int64 per document
    offsets         little-endian int64 per document: its first id in the block
    payload         the ids, `bits` bits each, least significant bit first

Any id is at bit `bits * i` of its payload, so a document or a single id is read
without what stands before it. Cases: null and empty texts have only the end
id; documents of one id may repeat and stand side by side in the order of their
texts, so the file is the same however often a task runs; documents without an
id come first (NO_ID stands for it in the file); very long texts make a block of
their own size; further columns are ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm.common import settle, slices, texts_of
from chronosift.llm.tokens import WORD_BPE, chunk_ids, encode, vocabulary_size
from chronosift.session import work_path

END_ID = 2
#: Ids of a block, at least (but for a part's last); a block ends with a document.
BLOCK_IDS = 1 << 18
#: Stands in the file for a missing doc_id.
NO_ID = -(1 << 63)
BLOCKS = "part int, block int, n_docs long, n_ids long, bits int, low long, high long, doc_ids binary, offsets binary, payload binary"


def bit_width(size: int) -> int:
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned integers to `bits` bits each."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """`count` ids from the `start`th on, reading only their bytes."""
    if count is None:
        count = len(payload) * 8 // bits - start
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype("<u4")
    first = start * bits
    raw = np.frombuffer(payload, np.uint8)[first // 8 : -(-(first + count * bits) // 8)]
    flat = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _block(part: int, block: int, doc_ids: list[int], ids: list[bytes], bits: int) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    offsets = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(ids), "<u4")
    values = (part, block, len(ids), len(flat), bits, doc_ids[0], doc_ids[-1], np.asarray(doc_ids, "<i8").tobytes(), offsets.astype("<i8").tobytes(), pack(flat, bits))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "block", "n_docs", "n_ids", "bits", "low", "high", "doc_ids", "offsets", "payload"])


def write(docs: DataFrame, path: str, name: str = WORD_BPE, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode all documents and write the file at `path`, whole parts in
    ascending doc_id order."""
    spark = docs.sparkSession
    end = np.asarray([end_id], "<u4").tobytes()
    bits = bit_width(max(vocabulary_size(name), end_id + 1))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        settle()
        part = TaskContext.get().partitionId()
        memo, doc_ids, ids, block, held = chunk_ids(name), [], [], 0, 0
        for s in slices(batches):
            for d, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist()):
                doc_ids.append(d)
                ids.append(encode(t, memo) + end)
                held += len(ids[-1]) // 4
                if held >= BLOCK_IDS:
                    yield _block(part, block, doc_ids, ids, bits)
                    doc_ids, ids, block, held = [], [], block + 1, 0
        if ids:
            yield _block(part, block, doc_ids, ids, bits)

    t = texts_of(docs).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    t = t.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    t.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start, n_tokens, ids_crc32, and what
    finds it again (part, block, first id in its block)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row per block; a part has few, and the parts' sums are as many as the file's parts
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).collect()
    before, at = {}, 0
    for p, n in sorted(map(tuple, sums)):
        before[p], at = at, at + n
    per_block = blocks.select("part", "block", "n_ids")
    starts = spark.createDataFrame(sorted(before.items()), "part int, part_start long")
    from pyspark.sql import Window as W

    w = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    places = per_block.join(starts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(w), F.lit(0))).alias("start"))
    whole = blocks.join(places, ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                doc_ids, offsets = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["offsets"], "<i8")
                ids = unpack(r["payload"], r["bits"], 0, r["n_ids"])
                ends = np.append(offsets[1:], r["n_ids"])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(offsets.tolist(), ends.tolist())]
                n = len(doc_ids)
                yield pa.record_batch(
                    [pa.array(doc_ids), pa.array(offsets + r["start"]), pa.array(ends - offsets), pa.array(crc, pa.int64()), pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(offsets)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "block", "at"],
                )

    out = whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int, at long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def ids_of(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document, unpacked alone (its end id included)."""
    hits = spark.read.schema(BLOCKS).parquet(path).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    for r in hits.toLocalIterator():
        doc_ids, offsets = np.frombuffer(r.doc_ids, "<i8"), np.frombuffer(r.offsets, "<i8")
        for i in np.flatnonzero(doc_ids == doc_id):
            end = offsets[i + 1] if i + 1 < len(offsets) else r.n_ids
            return unpack(bytes(r.payload), r.bits, int(offsets[i]), int(end - offsets[i])).tolist()
    raise KeyError(doc_id)


def round_trip(docs: DataFrame, path: str | None = None, name: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Write the file and read it back."""
    path = path or work_path(docs.sparkSession, "token-file")
    write(docs, path, name, end_id)
    return read(docs.sparkSession, path)
