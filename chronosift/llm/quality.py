"""Quality classifier: a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters slide over every chunk; each filter's rectified responses are
pooled to their maximum and mean per chunk, chunks are pooled to the mean and
maximum over the document, and a hidden layer combines them into one
probability. Only the text is an input.

Cases: null and empty texts are one chunk of padding and get a score like any
other; very long texts are many chunks and are scored in pieces of bounded
memory; repeated rows repeat their scores; with no labelled row, or one class
only, the score is the smoothed share of label 1; an empty table gives an empty
result; further columns are ignored; rows without a doc_id are scored, with a null
held_out, and match no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import arrow_map, slices, texts_of

CHUNK, STRIDE = 256, 192
#: Bytes under a filter, bytes from one place to the next (every byte is under WIDTH / STEP places), number of filters, hidden units.
WIDTH, STEP, FILTERS, HIDDEN = 6, 2, 16, 16
#: Labelled rows that a fit uses at most, each with all its chunks.
SAMPLE_DOCS = 2500
EPOCHS = 8
#: Chunks held at a time.
BLOCK = 256
THRESHOLD = 0.3


def byte_features(seed: int = 7) -> np.ndarray:
    """A fixed vector per byte: its class, and some random directions that tell bytes of a class apart."""
    b = np.arange(256)
    is_ = [
        (65 <= b) & (b <= 90), (97 <= b) & (b <= 122), (48 <= b) & (b <= 57), (b == 32), (9 <= b) & (b <= 13), b >= 128,
        (b > 32) & (b < 127) & ~((65 <= b) & (b <= 90)) & ~((97 <= b) & (b <= 122)) & ~((48 <= b) & (b <= 57)),
    ]
    rnd = np.random.default_rng(seed).normal(0, 0.7, (256, 5))
    rnd[0] = 0
    return np.hstack([np.stack(is_, 1), rnd]).astype(np.float32)


FEATURES = byte_features()


def chunks_of(data: bytes) -> np.ndarray:
    """All overlapping chunks of a text, (n, CHUNK) bytes, zero-padded."""
    n = max(1, -(-(len(data) - (CHUNK - STRIDE)) // STRIDE))
    room = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    room[: len(data)] = np.frombuffer(data, np.uint8)
    return as_strided(room, (n, CHUNK), (STRIDE, 1)).copy()


def windows(chunks: np.ndarray) -> np.ndarray:
    """(n * positions, WIDTH * features) inputs of the filters."""
    x = FEATURES[chunks]
    n, e = len(x), x.shape[2]
    s = x.strides
    return np.ascontiguousarray(as_strided(x, (n, POSITIONS, WIDTH * e), (s[0], STEP * s[1], s[2]))).reshape(-1, WIDTH * e)


POSITIONS = (CHUNK - WIDTH) // STEP + 1


class Net:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        fan = WIDTH * FEATURES.shape[1]
        self.p = {
            "w": rng.normal(0, fan**-0.5, (fan, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32),
            "u": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(np.float32), "c": np.zeros(HIDDEN, np.float32),
            "v": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), "d": np.zeros(1, np.float32),
        }

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(n, 2 * FILTERS): maximum and mean of each filter per chunk."""
        out = []
        for at in range(0, len(chunks), BLOCK):
            part = chunks[at : at + BLOCK]
            z = np.maximum(windows(part) @ self.p["w"] + self.p["b"], 0).reshape(len(part), POSITIONS, FILTERS)
            out.append(np.hstack([z.max(1), z.mean(1)]))
        return np.vstack(out)

    def head(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(f @ self.p["u"] + self.p["c"])
        return h, h @ self.p["v"] + self.p["d"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for whole texts, many or long."""
        rows, held, owner = [], [], []
        total = np.zeros((len(texts), 2 * FILTERS))
        top = np.zeros((len(texts), FILTERS), np.float32)
        count = np.zeros(len(texts))

        def flush() -> None:
            if held:
                p = self.pooled(np.vstack(held))
                own = np.concatenate(owner)
                np.add.at(total, own, p)
                np.maximum.at(top, own, p[:, :FILTERS])
                held.clear()
                owner.clear()

        waiting = 0
        for i, t in enumerate(texts):
            c = chunks_of(t.encode("utf-8", "replace"))
            count[i] = len(c)
            for at in range(0, len(c), 4096):
                held.append(c[at : at + 4096])
                owner.append(np.full(len(held[-1]), i))
                waiting += len(held[-1])
                if waiting >= 4096:
                    flush()
                    waiting = 0
        flush()
        f = np.hstack([total / count[:, None], top])
        return 1 / (1 + np.exp(-np.clip(self.head(f)[1], -30, 30)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, n: int, y: np.ndarray) -> dict[str, np.ndarray]:
        """Mean log-loss gradients of one batch; owner: ascending document of each chunk."""
        x = windows(chunks)
        z = np.maximum(x @ self.p["w"] + self.p["b"], 0).reshape(len(chunks), POSITIONS, FILTERS)
        best = z.argmax(1)
        high = np.take_along_axis(z, best[:, None], 1)[:, 0]
        mean = z.mean(1)
        starts = np.searchsorted(owner, np.arange(n))
        count = np.bincount(owner, minlength=n)[:, None]
        f = np.hstack([np.add.reduceat(high, starts) / count, np.add.reduceat(mean, starts) / count, np.maximum.reduceat(high, starts)])
        h, out = self.head(f)
        e = (1 / (1 + np.exp(-out)) - y) / n
        g = {"v": h.T @ e, "d": e.sum(keepdims=True)}
        dh = np.outer(e, self.p["v"]) * (1 - h * h)
        g["u"], g["c"] = f.T @ dh, dh.sum(0)
        df = dh @ self.p["u"].T
        d_high = (df[:, :FILTERS] / count)[owner]
        is_top = high == f[owner, 2 * FILTERS :]
        d_high = d_high + np.where(is_top, df[owner, 2 * FILTERS :], 0)
        dz = np.broadcast_to((df[:, FILTERS : 2 * FILTERS] / count / POSITIONS)[owner][:, None], z.shape).copy()
        i, j = np.ogrid[: len(chunks), :FILTERS]
        dz[i, best, j] += d_high
        dz *= z > 0
        dz = dz.reshape(-1, FILTERS)
        g["w"], g["b"] = x.T @ dz, dz.sum(0)
        return g

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> Net:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, max(1, epochs * -(-len(docs) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                own = np.repeat(np.arange(len(pick)), [len(docs[i]) for i in pick])
                g = self.gradients(np.vstack([docs[i] for i in pick]), own, len(pick), y[pick])
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    step = lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
        return self


def held_out():
    """Rows never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> tuple[list[np.ndarray], np.ndarray]:
    """Chunks and labels of at most `limit` labelled rows, those of smallest hash."""
    from pyspark.sql import Window as W

    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = one.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = texts_of(docs).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [chunks_of(t.encode("utf-8", "replace")).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "quality", "chunks"])

    got = rows.mapInArrow(run, "doc_id long, quality int, chunks binary")
    # one text per id, whatever order the rows come in
    w = W.partitionBy("doc_id").orderBy("chunks")
    got = got.withColumn("n", F.row_number().over(w)).where("n = 1").orderBy("doc_id").collect()
    return [np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK) for r in got], np.array([float(r.quality > 0) for r in got], np.float32)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Net:
    chunks, y = sample(docs, labels, limit)
    net = Net()
    share = (y.sum() + 1) / (len(y) + 2)
    net.p["d"][:] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        return net.fit(chunks, y)
    net.p["v"][:] = 0
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted."""
    t = _scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")), fit(docs, labels, limit))
    return t.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with all their columns whatever their names, that score at least `threshold`."""
    t = docs.select(F.coalesce("text", F.lit("")).alias("__text"), *[F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(docs.columns)])
    good = _scored(t, fit(docs, labels, limit)).where(F.col("__score") >= threshold)
    return good.select(*[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _scored(source: DataFrame, net: Net) -> DataFrame:
    """The columns but `__text`, and `__score`."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = net.scores(b.column("__text").to_pylist())
        more = [n for n in b.schema.names if n != "__text"]
        return pa.record_batch([*[b.column(n) for n in more], pa.array(s, pa.float64())], names=[*more, "__score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    return arrow_map(source, run, f"{kinds}, __score double", "__text")
