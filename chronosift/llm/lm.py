"""Language-model scores: a word-count base and a causal self-attention model.

Base: add-one unigram over white-space words, with counts of all training
documents. Model: one causal self-attention block in numpy over subword ids of a
public vocabulary, with a softmax of two levels: a class of ids, then the id
within its class. Both depend on the context; within a class, ids start from
their counts over all training documents and have a learned vector each. The
product is a probability for every id. The SINGLE most frequent ids are classes
of their own; the others follow by frequency in classes as large as keeps size
times share of the text at CLASS_COST, which balances the cost of both levels.

Weights are fitted in two steps. A start is fitted on the driver with START_DOCS
documents, whatever the input size. From there blocks of BLOCK_BYTES of text are
learned from, every position of every whole training text once, in ROUNDS
rounds: each block of a round is trained on from the round's weights, then the
blocks' weights are averaged. Blocks follow from the documents alone and what is
averaged are integers, so scores depend neither on cores nor on partitions, and
no task grows with the input.

A document is scored in overlapping windows, each position once: the first
window scores all of its positions, later ones only those that the window before
did not reach, with at least WINDOW - FRESH ids of context.

Documents are dealt into blocks of bounded size. A block counts its distinct
words; these move once, by word, in order: a word's counts are summed, it is
encoded once, and both go back to the blocks that hold the word, a few rows of
compressed words a block. No task holds the corpus' vocabulary. A block's words
meet its documents once, whose ids are then kept: learning and scoring read ids,
not texts.

Cases: null and empty texts have the end token alone; a null doc_id counts as a
training document; with no training document all counts are zero; repeated rows
are scored each; very long texts are windows like any other; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import settle, slices, texts_of
from chronosift.llm.tokens import WORD_BPE, chunk_ids, vocabulary_size
from chronosift.session import stored

WINDOW, FRESH = 32, 24
DIM, HIDDEN = 16, 32
#: Classes of a single id, most ids in a class, ids with an embedding of their own (rarer ones have their class's).
SINGLE, LARGEST, EMBEDDED = 80, 4096, 2048
#: Ids of a class times the share of the text that falls into it, about.
CLASS_COST = 2.0
#: Documents of the start, segments of each, passes over them.
START_DOCS, START_SEGMENTS, START_PASSES = 1000, 8, 2
#: Bytes of a segment of the start's texts; bytes of context before it.
SEGMENT, LEAD = 512, 64
#: Bytes of text in a block, about; rounds of learning, after each of which the blocks' weights are averaged.
BLOCK_BYTES, ROUNDS = 8 << 20, 2
#: Fixed-point steps of a unit in the averaging.
STEPS = 1 << 20
#: Words whose ids a worker keeps, and as many parts of words; bytes of text learned from at a time, about. Both bound
#: what a Python worker holds beside the JVM.
WORDS_KEPT, LEARN_BYTES = 60_000, 2 << 20
#: Bytes of a block's texts whose words are looked up at a time, about.
SCORE_BYTES = 8 << 20
#: Tokens scored at a time, about; a longer text is scored whole.
TOKENS = 1 << 19
#: Windows computed at a time; positions whose classes are looked into at a time; numbers of one softmax table.
BATCH, POSITIONS, TABLE = 128, 1 << 16, 1 << 20
#: Numbers of a weight array in one row of the averaging.
CHUNK = 1 << 14
#: Words of all blocks that are packed at a time, about.
PACK_ROWS = 200_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


_SPACE_THEN_WORD = re.compile(rb"[\t-\r ](?![\t-\r ])")


def _word_start(data: bytes, at: int) -> int:
    """The first place from `at` on where a word begins."""
    if at <= 0:
        return 0
    found = _SPACE_THEN_WORD.search(data, at - 1)
    return found.end() if found else len(data)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = lists.flatten().cast(pa.binary())
    real = pc.not_equal(pc.binary_length(flat), 0)  # spaces at the ends leave empty strings
    ends = np.cumsum(n)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return flat.filter(real), before[ends] - before[ends - n]


@dataclass
class Vocabulary:
    """Ids as the model sees them. Index `size` is the document's end."""

    class_of: np.ndarray
    log_within: np.ndarray
    embedding_of: np.ndarray
    n_classes: int
    #: Ids by frequency, each id's place there, and where each class begins there.
    order: np.ndarray
    rank: np.ndarray
    edges: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        mass = counts.astype(float) + 1
        before = np.concatenate([[0.0], np.cumsum(mass[order] / mass.sum())])
        edges = [*range(min(SINGLE, len(counts)) + 1)]
        while (at := edges[-1]) < len(counts):
            sizes = np.arange(1, min(LARGEST, len(counts) - at) + 1)
            fits = np.searchsorted(sizes * (before[at + sizes] - before[at]), CLASS_COST, "right")
            edges.append(at + max(1, int(fits)))
        n = len(edges) - 1
        class_of, rank = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        class_of[order], rank[order] = np.repeat(np.arange(n), np.diff(edges)), np.arange(len(counts))
        within = np.bincount(class_of, mass, n)
        embedding = np.full(len(counts), EMBEDDED)
        embedding[order[:EMBEDDED]] = np.arange(min(EMBEDDED, len(counts)))
        rare = order[EMBEDDED:]
        embedding[rare] = EMBEDDED + class_of[rare]
        return cls(class_of, np.log10(mass / within[class_of]), embedding, n, order, rank, np.array(edges))


class Attention:
    """Parameters, forward and backward pass of the model."""

    def __init__(self, n_classes: int, seed: int = 5, vocabulary: Vocabulary | None = None):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.n = n_classes
        self.start = EMBEDDED + n_classes  # the embedding in front of a document
        self.p = {
            "e": rng.normal(0, 0.5, (self.start + 1, DIM)).astype(np.float32), "pos": rng.normal(0, 0.1, (WINDOW, DIM)).astype(np.float32),
            "q": w(DIM, DIM), "k": w(DIM, DIM), "v": w(DIM, DIM), "o": w(DIM, DIM), "w1": w(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "w2": w(HIDDEN, n_classes) * np.float32(0.5), "w3": w(DIM, n_classes) * np.float32(0.5), "b": np.zeros(n_classes, np.float32),
        }
        self.vocabulary = vocabulary
        if vocabulary:
            # a vector for each id and its count, by frequency: a class is a slice
            self.p["u"] = np.zeros((len(vocabulary.order), DIM), np.float32)
            self.prior = (vocabulary.log_within[vocabulary.order] * np.log(10)).astype(np.float32)
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.table: np.ndarray | None = None

    def forward(self, x: np.ndarray) -> tuple:
        """x: (B, WINDOW) embedding numbers; probabilities of the classes after each position, and what the backward pass needs."""
        out, rest = self._logits(x)
        return _softmax(out).reshape(*x.shape, self.n), rest

    def _wide(self) -> np.ndarray:
        return np.hstack([self.p["q"] * np.float32(DIM**-0.5), self.p["k"], self.p["v"]])

    def _logits(self, x: np.ndarray) -> tuple:
        p = self.p
        h = p["e"].take(x, 0)
        h += p["pos"]
        h = h.reshape(-1, DIM)
        q, k, v = np.split((h @ self._wide()).reshape(*x.shape, -1), 3, axis=-1)
        s = self._attend(q, k)
        s /= s @ np.ones((WINDOW, 1), np.float32)
        c = (s @ v).reshape(-1, DIM)
        y = c @ p["o"]
        y += h
        a = self._head(y)
        return a @ np.vstack([p["w2"], p["w3"], p["b"]]), (h, q, k, v, s, c, a)

    def _head(self, y: np.ndarray) -> np.ndarray:
        """What the classes' logits are linear in: hidden values, y and 1."""
        a = np.empty((len(y), HIDDEN + DIM + 1), np.float32)
        a[:, HIDDEN:-1], a[:, -1] = y, 1
        np.maximum(a[:, HIDDEN:] @ np.vstack([self.p["w1"], self.p["b1"]]), 0, out=a[:, :HIDDEN])
        return a

    def _attend(self, q: np.ndarray, k: np.ndarray, bounded: bool = False) -> np.ndarray:
        """Unnormalised attention of every position to itself and those before it."""
        s = q @ k.transpose(0, 2, 1)
        if not bounded and not s.max(initial=0) < 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= self.seen[-s.shape[1] :]
        return s

    def body(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """What `forward` computes below the head, for places from `first` on. The projections of every
        embedding and place are looked up, as they are sums of one of each; a
        column of ones beside the values gives the sum of the attention."""
        if self.table is None:
            p = self.p
            wide = np.hstack([p["q"] * np.float32(DIM**-0.5), p["k"], np.eye(DIM, dtype=np.float32), p["v"] @ p["o"], np.zeros((DIM, 1), np.float32)])
            self.table, self.places = p["e"] @ wide, p["pos"] @ wide
            self.places[:, -1] = 1
            norm = lambda at: sum(np.linalg.norm(t[:, at : at + DIM], axis=1).max() for t in (self.table, self.places))
            self.bounded = bool(norm(0) * norm(DIM) < 60)
            self.top = np.vstack([p["w2"], p["w3"], p["b"]])
        g = self.table.take(x, 0)
        g += self.places
        s = self._attend(g[:, first:, :DIM], g[..., DIM : 2 * DIM], self.bounded)
        c = s @ g[..., 3 * DIM :]
        c[..., :DIM] /= c[..., DIM:]
        return g[:, first:, 2 * DIM : 3 * DIM] + c[..., :DIM]

    def chosen(self, y: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of one class at each position."""
        p = self.p
        top = self.top if self.table is not None else np.vstack([p["w2"], p["w3"], p["b"]])
        return _log_softmax_at(self._head(y) @ top, target)

    def several(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
        """The positions whose class has several ids, by class, and the targets'
        places in their classes; for each class its slice of `u`, and the slice
        of those positions that it has. Positions are split so that no table of
        logits has much more than TABLE numbers."""
        v = self.vocabulary
        c = v.class_of[ids]
        at = np.flatnonzero((np.diff(v.edges) > 1)[c])
        at = at[np.argsort(c[at].astype(np.uint16), kind="stable")]
        c = c[at]
        parts = []
        cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
        for first, last in zip(cuts, cuts[1:]):
            if first < last:
                own = slice(*v.edges[c[first] : c[first] + 2].tolist())
                step = max(1, TABLE // (own.stop - own.start))
                parts += [(own, slice(lo, min(last, lo + step))) for lo in range(first, last, step)]
        return at, v.rank[ids[at]] - v.edges[c], parts

    def inside(self, y: np.ndarray, own: slice) -> np.ndarray:
        """Logits of the ids of a class of several."""
        out = y @ self.p["u"][own].T
        out += self.prior[own]
        return out

    def chosen_id(self, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log-probability of one id within its class at each position."""
        at, place, parts = self.several(ids)
        y, own = y.take(at, 0), np.zeros(len(at))
        for ids_of, rows in parts:
            own[rows] = _log_softmax_at(self.inside(y[rows], ids_of), place[rows])
        out = np.zeros(len(ids))
        out[at] = own
        return out

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, ids: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], dict[tuple[int, int], np.ndarray]]:
        """Of the mean loss: of all arrays but `u`, and of the slices of `u` that the ids concern."""
        p, wide = self.p, self._wide()
        d, (h, q, k, v, s, c, a) = self._logits(x)
        y = a[:, HIDDEN:-1]
        share = (weight / weight.sum()).astype(np.float32).ravel()
        _errors(d, target.ravel(), share)
        top = a.T @ d
        g = {"w2": top[:HIDDEN], "w3": top[HIDDEN:-1], "b": top[-1]}
        da = d @ np.vstack([p["w2"], p["w3"]]).T
        dz = da[:, :HIDDEN]
        dz *= a[:, :HIDDEN] > 0
        low = a[:, HIDDEN:].T @ dz
        g["w1"], g["b1"] = low[:-1], low[-1]
        dy = dz @ p["w1"].T
        dy += da[:, HIDDEN:]
        du: dict[tuple[int, int], np.ndarray] = {}
        if ids is not None:
            real = np.flatnonzero(share)
            at, place, parts = self.several(ids.ravel()[real])
            at = real[at]
            ys, dys, part = y.take(at, 0), np.empty((len(at), DIM), np.float32), share[at]
            for own, rows in parts:
                e = self.inside(ys[rows], own)
                _errors(e, place[rows], part[rows])
                key, new = (own.start, own.stop), e.T @ ys[rows]
                du[key] = du[key] + new if key in du else new
                np.matmul(e, p["u"][own], out=dys[rows])
            dy[at] += dys
        g["o"] = c.T @ dy
        dc = dy @ p["o"].T
        # the attention's mean of the errors of its weights is that of the values' errors
        mean = (dc * c) @ np.ones(DIM, np.float32)
        dc = dc.reshape(*x.shape, DIM)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= mean.reshape(*x.shape, 1)
        ds *= s
        below = np.empty((*x.shape, 3 * DIM), np.float32)
        np.matmul(ds, k, out=below[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=below[..., DIM : 2 * DIM])
        np.matmul(s.transpose(0, 2, 1), dc, out=below[..., 2 * DIM :])
        below = below.reshape(-1, 3 * DIM)
        g["q"], g["k"], g["v"] = np.split(h.T @ below, 3, axis=1)
        g["q"] = g["q"] * np.float32(DIM**-0.5)
        dh = below @ wide.T
        dh += dy
        g["pos"] = dh.reshape(len(x), -1).sum(0).reshape(-1, DIM)
        places = (x.ravel() * DIM)[:, None] + np.arange(DIM)
        g["e"] = np.bincount(places.ravel(), dh.ravel(), p["e"].size).astype(np.float32).reshape(p["e"].shape)
        return g, du

    def trainer(self, rate: float) -> Trainer:
        return Trainer(self, rate)

    def fit(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, passes: int = START_PASSES, batch: int = 128, rate: float = 4e-3, seed: int = 9, ids: np.ndarray | None = None) -> Attention:
        rng, to = np.random.default_rng(seed), self.trainer(rate)
        steps = max(1, passes * -(-len(x) // batch))
        for _ in range(passes):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                to.step(x[pick], target[pick], weight[pick], None if ids is None else ids[pick], 1 - (to.t + 1) / (steps + 1))
        return self


class Trainer:
    """Steps with moments of the gradients; slices of `u` have moments of their own and are touched only where ids occur.
    All other arrays become views of one, which a step moves at once."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.names = [k for k in model.p if k != "u"]
        self.p = np.concatenate([model.p[k].ravel() for k in self.names])
        ends = np.cumsum([model.p[k].size for k in self.names])
        model.p.update({k: part.reshape(model.p[k].shape) for k, part in zip(self.names, np.split(self.p, ends[:-1]))})
        zeros = lambda p: (np.zeros_like(p), np.zeros_like(p))
        self.moments, self.u_moments = zeros(self.p), zeros(model.p["u"]) if "u" in model.p else ()
        self.touched: dict[tuple[int, int], int] = {}

    def _move(self, p: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray, t: int, rate: float) -> None:
        """m and s are 10 and 100 times the moments, so that gradients are added as they are; overwrites g."""
        m *= np.float32(0.9)
        m += g
        s *= np.float32(0.99)
        g *= g
        s += g
        scale = (0.01 / (1 - 0.99**t)) ** 0.5
        np.sqrt(s, out=g)
        g += np.float32(1e-8 / scale)
        np.divide(m, g, out=g)
        g *= np.float32(0.1 * rate / (1 - 0.9**t) / scale)
        p -= g

    def step(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, ids: np.ndarray | None, factor: float) -> None:
        g, du = self.model.gradients(x, target, weight, ids)
        self.t += 1
        rate = self.rate * factor
        self._move(self.p, *self.moments, np.concatenate([g[k].ravel() for k in self.names]), self.t, rate)
        for (lo, hi), v in du.items():
            t = self.touched[lo, hi] = self.touched.get((lo, hi), 0) + 1
            self._move(self.model.p["u"][lo:hi], *[part[lo:hi] for part in self.u_moments], v, t, rate)
        self.model.table = None


def _softmax(out: np.ndarray) -> np.ndarray:
    """In place; rows are moved only where single-precision powers of e need it."""
    if not (out.max(initial=0) < 80 and out.min(initial=0) > -80):
        out -= out.max(-1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(-1, keepdims=True)
    return out


def _errors(out: np.ndarray, target: np.ndarray, share: np.ndarray) -> None:
    """In place: each row's softmax less 1 at its target, times its share. Rows
    are moved as in `_log_softmax_at`."""
    flat, at = out.reshape(-1), np.arange(0, out.size, out.shape[1]) + target
    if not (out.max(initial=0) < 80 and flat.take(at).min(initial=0) > -80):
        out -= out.max(-1, keepdims=True)
    np.exp(out, out=out)
    out *= (share / (out @ np.ones(out.shape[1], np.float32)))[:, None]
    flat[at] -= share


def _log_softmax_at(out: np.ndarray, target: np.ndarray) -> np.ndarray:
    """One entry a row of the log-softmax; overwrites `out`. Rows are moved to
    a maximum of 0 only where single-precision powers of e need it: not if
    nothing is above 80 and each row has an entry, the target's, above -80."""
    at = np.arange(0, out.size, out.shape[1]) + target
    own = out.take(at)
    if not (out.max(initial=0) < 80 and own.min(initial=0) > -80):
        out -= out.max(-1, keepdims=True)
        own = out.take(at)
    np.exp(out, out=out)
    return own - np.log(out @ np.ones(out.shape[1], np.float32))


def layout(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts over n positions, and each window's first scored place."""
    more = max(0, -(-(n - WINDOW) // FRESH))
    starts = np.arange(more + 1) * FRESH
    first = np.full(more + 1, WINDOW - FRESH)
    first[0] = 0
    return starts, first


def batch_windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many positions side by side: each window's place in
    the joined sequence, its first scored place, and how many it may reach."""
    n = np.maximum(0, -(-(lengths - WINDOW) // FRESH)) + 1
    doc = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(lengths) - lengths, n) + nth * FRESH
    return starts, np.where(nth > 0, WINDOW - FRESH, 0), lengths[doc] - nth * FRESH


def side_by_side(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many positions one after another: windows that hold
    each position once, by their first place and how many they may reach."""
    n = -(-lengths // WINDOW)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(lengths) - lengths, n) + nth * WINDOW, np.repeat(lengths, n) - nth * WINDOW


class Scorer:
    def __init__(self, vocabulary: Vocabulary, model: Attention, name: str = WORD_BPE):
        self.vocabulary, self.model, self.name = vocabulary, model, name
        self.end = len(vocabulary.class_of) - 1

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Subword ids with the end in last place."""
        memo = chunk_ids(self.name, WORDS_KEPT)
        end = np.array([self.end], np.int64)
        return [np.concatenate([np.frombuffer(b"".join([memo[w.decode()] for w in words_of(t)]), "<u4").astype(np.int64), end]) for t in texts]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, each text with the end in last
        place, and how many each has; a distinct word is looked up once."""
        memo = chunk_ids(self.name, WORDS_KEPT)
        words, n = words_in(texts)
        words = words.dictionary_encode()
        own = [memo[w.decode()] for w in words.dictionary.to_pylist()]
        flat, size = np.frombuffer(b"".join(own), "<u4").astype(np.int64), np.array([len(x) // 4 for x in own], np.int64)
        at = words.indices.to_numpy()
        k = size[at]
        ends = np.cumsum(k)
        places = np.repeat((np.cumsum(size) - size)[at] - (ends - k), k) + np.arange(k.sum())
        cuts = np.append(0, ends)[np.append(0, np.cumsum(n))]
        return np.insert(flat[places], cuts[1:], self.end), np.diff(cuts) + 1

    def inputs(self, target: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Embedding numbers of what stands before each position."""
        x = np.empty(len(target), np.int64)
        x[1:] = self.vocabulary.embedding_of[target[:-1]]
        x[np.cumsum(lengths) - lengths] = self.model.start
        return x

    def scores(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each whole text."""
        ids = self.ids(texts)
        return self.scores_of(np.concatenate(ids), np.array([len(x) for x in ids]))

    def scores_of(self, target: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of id sequences of such lengths side by side."""
        v = self.vocabulary
        x = self.inputs(target, lengths)
        starts, first, room = batch_windows(lengths)
        wanted = v.class_of[target]
        log_p = np.zeros(len(target))
        steps = np.arange(WINDOW)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        # documents' first windows, then the others: of each only the places that it scores are computed
        batches = [(f, own[at : at + BATCH]) for f in (0, WINDOW - FRESH) for own in [np.flatnonzero(first == f)] for at in range(0, len(own), BATCH)]
        for nth, (f, own) in enumerate(batches, 1):
            s, r = starts[own, None], room[own, None]
            inside = steps < r
            places = np.where(inside, s + steps, s)
            y = self.model.body(x.take(places), f).reshape(-1, DIM)
            inside, hit = inside[:, f:].ravel(), places[:, f:].ravel()
            if not inside.all():
                y, hit = y[inside], hit[inside]
            log_p[hit] = self.model.chosen(y, wanted.take(hit))
            held.append((y, hit))
            n_held += len(hit)
            if n_held >= POSITIONS or nth == len(batches):
                y, hit = (np.concatenate(part) for part in zip(*held))
                log_p[hit] += self.model.chosen_id(y, target[hit])
                held, n_held = [], 0
        log_p /= np.log(10)
        return np.add.reduceat(log_p, np.cumsum(lengths) - lengths)

    def segments(self, text: str, key: int, share: int, most: int | None = None) -> list[np.ndarray]:
        """Rows of WINDOW inputs, WINDOW target ids and WINDOW flags of real
        positions, of one segment of bytes in `share`, chosen by hash of `key`
        and the segment's number; each is cut into windows side by side. `most`
        bounds the segments (for the start only)."""
        data = text.encode("utf-8", "replace")
        n = max(1, -(-len(data) // SEGMENT))
        first = (key & 0xFFFFFFFFFFFF) * 0x9E3779B97F4A7C15
        picked = [i for i in range(n) if ((i + first) * 0xD6E8FEB86659FD93 >> 40 & 0xFFFFFF) % share == 0]
        if not picked:
            return []
        data = data.lower()
        if most is not None:
            picked = picked[:: max(1, -(-len(picked) // most))]
        memo, out = chunk_ids(self.name, WORDS_KEPT), []
        steps = np.arange(WINDOW)
        for i in picked:
            # a word belongs to the segment that it begins in; the words before it are context, or the document's start
            begin, end = _word_start(data, i * SEGMENT), _word_start(data, (i + 1) * SEGMENT)
            words = data[_word_start(data, max(0, begin - LEAD)) : end].split()
            target = np.frombuffer(b"".join([memo[w.decode()] for w in words]), "<u4").astype(np.int64)
            if i == n - 1:
                target = np.append(target, self.end)
            if not len(target):
                continue
            x = self.inputs(target, np.array([len(target)]))
            if i:  # the text goes on from what isn't looked at: the first position is not learned from
                x, target = x[1:], target[1:]
            s = np.arange(0, len(target), WINDOW)
            places = s[:, None] + steps
            inside = places < len(target)
            places = np.where(inside, places, s[:, None])
            out.append(np.hstack([x[places], target[places], inside]).astype("<i4"))
        return out

    def start_from(self, rows: np.ndarray) -> Scorer:
        if len(rows):
            x, ids, inside = np.split(rows, 3, axis=1)
            t = self.vocabulary.class_of[ids]
            bias = np.log(np.bincount(t.ravel(), minlength=self.model.n) + 1.0)
            self.model.p["b"][:] = bias - bias.max()
            self.model.fit(x, t, inside.astype(np.float32), ids=ids)
            self.model.table = None
        return self


def subword_counts(totals: DataFrame, name: str = WORD_BPE) -> tuple[np.ndarray, int, int]:
    """How often each id occurs in the training texts, with a place for the end, and
    the number of words and of distinct words there; totals: (id, n) of `word_packs`."""
    out, sums = np.zeros(vocabulary_size(name) + 1, np.int64), {N_WORDS: 0, N_DISTINCT: 0}
    for r in totals.groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per id of the vocabulary
        if r.id < 0:
            sums[r.id] = r.n
        else:
            out[r.id] = r.n
    return out, sums[N_WORDS], sums[N_DISTINCT]


def start(docs: DataFrame, scorer: Scorer, limit: int = START_DOCS) -> Scorer:
    """Weights fitted on at most `limit` training documents."""
    t = texts_of(docs.where(~held_out())).withColumn("key", F.xxhash64("doc_id", F.octet_length("text")))
    keys = t.select("key").distinct().orderBy("key").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in slices(batches):
            rows = [scorer.segments(t, k, 1, START_SEGMENTS) for t, k in zip(b.column("text").to_pylist(), b.column("key").to_pylist())]
            yield pa.record_batch([b.column("key"), pa.array([np.vstack(r).tobytes() if r else b"" for r in rows], pa.binary())], names=["key", "windows"])

    # as many longs as `limit` are broadcast; of rows that share a key one counts
    rows = t.join(F.broadcast(keys), "key", "left_semi").select("key", "text").mapInArrow(run, "key long, windows binary").groupBy("key").agg(F.min("windows").alias("windows"))
    rows = sorted((r.key, bytes(r.windows)) for r in rows.collect())
    return scorer.start_from(np.frombuffer(b"".join(w for _, w in rows), "<i4").reshape(-1, 3 * WINDOW))


#: A row of some documents as a compressed Arrow stream, and its number in the block: doc_id, held_out and text, or IDS.
PACKED = "block int, part int, data binary"
#: What is known of a document once its words have their counts and ids; ids with the end in last place.
IDS = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids")


def stream_of(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(t)
    return out.getvalue().to_pybytes()


def packed_row(block: int, part: int, t: pa.Table) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([stream_of(t)], pa.binary())], names=["block", "part", "data"])


def in_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Documents with the block they fall into, by hash: the same whatever the partitions."""
    t = texts_of(docs).withColumn("held_out", held_out())
    return t.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))


def packed(docs: DataFrame, n_blocks: int) -> DataFrame:
    """The documents by block, some LEARN_BYTES of text in a row, compressed; a
    block's documents are in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nth, held, size = None, 0, [], 0
        row = lambda: packed_row(block, nth, pa.Table.from_batches(held).combine_chunks())

        for s in slices(batches, size=LEARN_BYTES):
            of = s.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = s.slice(lo, hi - lo).select(["doc_id", "held_out", "text"])
                ends = np.cumsum(pc.binary_length(part.column("text")).to_numpy())
                # rows end by the documents alone, not by how the batches come
                at = 0
                while at < len(ends):
                    if held and (of[lo] != block or size >= LEARN_BYTES):
                        yield row()
                        nth, held, size = nth + 1 if of[lo] == block else 0, [], 0
                    before = int(ends[at - 1]) if at else 0
                    upto = min(len(ends), int(np.searchsorted(ends, before + max(1, LEARN_BYTES - size), "left")) + 1)
                    held.append(part.slice(at, upto - at))
                    size += int(ends[upto - 1]) - before
                    block, at = int(of[lo]), upto
        if held:
            yield row()

    dealt = in_blocks(docs, n_blocks).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionById(n_blocks, F.col("block"))
    order = dealt.withColumn("key", F.xxhash64("text", "doc_id")).sortWithinPartitions("block", "key", "doc_id")
    return order.select("block", "doc_id", "held_out", "text").mapInArrow(run, PACKED)


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """For each packed row its block and what it holds."""
    for block, data in zip(b.column("block").to_pylist(), b.column("data")):
        for part in pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().to_batches():
            yield block, part


def ids_array(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list of ids for each length, in two bytes an id where they fit."""
    kind = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(ids.astype(kind)))


def ids_in(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each list has."""
    return lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)


def learn(docs: DataFrame, scorer: Scorer, n_blocks: int, share: int = 1, rate: float = 2e-3) -> Scorer:
    """`learn_blocks` of documents dealt into so many blocks, which are encoded as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for at, (k, own) in enumerate(unpacked(b)):
                yield packed_row(k, b.column("part")[at].as_py(), pa.table([own.column("held_out"), ids_array(*scorer.encoded(own.column("text")))], names=["held_out", "ids"]))

    return learn_blocks(stored(packed(docs, n_blocks).mapInArrow(run, PACKED), "packed-ids"), scorer, n_blocks, share, rate)


def learn_blocks(blocks: DataFrame, scorer: Scorer, n_blocks: int, share: int = 1, rate: float = 2e-3) -> Scorer:
    """One pass over all training documents in ROUNDS rounds. In a round each of
    its blocks is trained on from the round's weights, whatever task has it, then
    the weights are averaged by the windows seen. Every position of every whole
    text is learned from once; a caller that wants less takes one window in
    `share`. Changes are summed as integers, so cores, tasks and their order
    don't show in the result. Arrays travel in chunks, of which an aggregation
    holds one at a time."""
    done = 0
    for r in range(min(ROUNDS, n_blocks)):
        lo, hi = r * n_blocks // min(ROUNDS, n_blocks), (r + 1) * n_blocks // min(ROUNDS, n_blocks)
        done += _round(blocks.where((F.col("block") >= lo) & (F.col("block") < hi)), scorer, share, rate, done) // (hi - lo)
    return scorer


def _round(blocks: DataFrame, scorer: Scorer, share: int, rate: float, done: int) -> int:
    """Windows learned from in a round; `done`: those of a block in the rounds before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        v, steps, batch = scorer.vocabulary, np.arange(WINDOW), 128
        before = {k: a.copy() for k, a in scorer.model.p.items()}
        sums: dict[tuple[str, int], np.ndarray] = {}
        block, to, seen, total = None, None, 0, 0

        def add() -> int:
            """The block's changes times its windows; the next begins at the round's weights."""
            for k, a in scorer.model.p.items():
                flat, old = a.ravel(), before[k].ravel()
                for at in range(0, len(flat) if seen else 0, CHUNK):
                    if not np.array_equal(part := flat[at : at + CHUNK], old[at : at + CHUNK]):
                        change = np.rint((part - old[at : at + CHUNK]).astype(np.float64) * STEPS).astype(np.int64) * seen
                        sums[k, at] = sums[k, at] + change if (k, at) in sums else change
                a[...] = before[k]
            return seen

        for b in batches:
            for k, own in unpacked(b):
                if k != block:
                    total += add()
                    block, to, seen = k, scorer.model.trainer(rate), 0
                own = own.filter(pc.invert(own.column("held_out")))
                if not own.num_rows:
                    continue
                ids, lengths = ids_in(own.column("ids"))
                x = scorer.inputs(ids, lengths)
                starts, room = side_by_side(lengths)
                order = np.random.default_rng(len(starts)).permutation(len(starts))[::share]
                for at in range(0, len(order), batch):
                    s, r = starts[order[at : at + batch], None], room[order[at : at + batch], None]
                    inside = steps < r
                    places = np.where(inside, s + steps, s)
                    to.step(x[places], v.class_of[ids[places]], inside.astype(np.float32), ids[places], (1 + (to.t + done / batch) / 100) ** -0.5)
                    seen += len(s)
        total += add()
        for (k, at), change in sums.items():
            yield pa.record_batch([pa.array([k]), pa.array([at]), pa.array([0]), pa.array([change.tobytes()], pa.binary())], names=["name", "at", "n", "change"])
        yield pa.record_batch([pa.array([""]), pa.array([0]), pa.array([total]), pa.array([b""], pa.binary())], names=["name", "at", "n", "change"])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums what a task gets, array chunk by array chunk."""
        held: dict[tuple[str, int], list] = {}
        for b in parts:
            for k, at, n, change in zip(*[b.column(c).to_pylist() for c in ("name", "at", "n", "change")]):
                own = held.setdefault((k, at), [0, 0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(change, np.int64)
        for (k, at), (n, change) in held.items():
            yield pa.record_batch([pa.array([k]), pa.array([at]), pa.array([n]), pa.array([np.asarray(change).tobytes()], pa.binary())], names=["name", "at", "n", "change"])

    schema = "name string, at long, n long, change binary"
    copies = blocks.mapInArrow(run, schema).repartition("name", "at")
    sums = copies.mapInArrow(added, schema).collect()  # one row per chunk of an array
    n = sum(r.n for r in sums)
    for r in sums:
        if r["name"]:
            flat, change = scorer.model.p[r["name"]].reshape(-1), np.frombuffer(bytes(r.change), np.int64)
            flat[r["at"] : r["at"] + len(change)] += (change / (n * STEPS)).astype(np.float32)
    scorer.model.table = None
    return n


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, word, n): each block's distinct words, and how often each occurs in its training documents."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        return t.select(["word", "n_sum"]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: dict[int, list[pa.Table]] = defaultdict(list)
        for b in batches:
            for k, own in unpacked(b):
                words, n = words_in(own.column("text"))
                asked = np.repeat(own.column("held_out").to_numpy(zero_copy_only=False), n)
                counted = words.filter(pa.array(~asked)).value_counts()
                also = words.filter(pa.array(asked)).unique()
                held[k] += [pa.table([counted.field("values"), counted.field("counts")], names=["word", "n"]), pa.table([also, pa.array(np.zeros(len(also), np.int64))], names=["word", "n"])]
                if len(held[k]) >= 16:
                    held[k] = [merged(held[k])]
        for k, parts in held.items():
            for b in merged(parts).to_batches(20_000):
                yield pa.record_batch([pa.array(np.full(b.num_rows, k, np.int32)), b.column("word"), b.column("n")], names=["block", "word", "n"])

    return blocks.mapInArrow(run, "block int, word binary, n long")


#: In place of an id in the totals of `word_packs`.
N_WORDS, N_DISTINCT = -1, -2


def word_packs(held: DataFrame, name: str = WORD_BPE) -> DataFrame:
    """(block, data, id, n) from each block's (block, word, n). Rows with a block
    hold some of its words as a compressed Arrow stream of word, c (the count over
    all blocks) and ids (encoded once for all blocks); rows without one hold how
    often the training texts have an id. Words move once; a word has one row a
    block at most, in order, so no task holds more than PACK_ROWS of them."""
    names = ["word", "c", "ids"]

    def packs(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(parts)
        block = t.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        t, block = t.take(pa.array(order)).select(names).combine_chunks(), block[order]
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield row(pa.array(block[lo : lo + 1], pa.int32()), pa.array([stream_of(t.slice(lo, hi - lo))], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()))

    row = lambda *columns: pa.record_batch([*columns], names=["block", "data", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        memo, total, n_words, distinct = chunk_ids(name, WORDS_KEPT), np.zeros(vocabulary_size(name)), 0, 0
        last, parts, rows = None, [], 0

        def finished(t: pa.Table) -> pa.Table:
            """Rows of whole words with their counts and ids; the totals are added to."""
            nonlocal n_words, distinct
            word = t.column("word").combine_chunks().dictionary_encode()
            word = word.combine_chunks() if isinstance(word, pa.ChunkedArray) else word
            at = word.indices.to_numpy()
            c = np.bincount(at, t.column("n").to_numpy(), len(word.dictionary)).astype(np.int64)
            ids = [memo.compute(w.decode()) for w in word.dictionary.to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids])
            total[:] += np.bincount(np.frombuffer(b"".join(ids), "<u4"), np.repeat(c, sizes), len(total))
            n_words, distinct = n_words + int(c.sum()), distinct + int((c > 0).sum())
            return pa.table([t.column("block"), t.column("word"), pa.array(c[at]), pa.array(ids, pa.binary()).take(word.indices)], names=["block", *names])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([last, t]).combine_chunks() if last is not None else t
            if not t.num_rows:
                continue
            # the last word may go on in the next batch
            at = pc.index(t.column("word"), t.column("word")[-1]).as_py()
            last = t.slice(at)
            if at:
                parts.append(finished(t.slice(0, at)))
                rows += at
            if rows >= PACK_ROWS:
                yield from packs(parts)
                parts, rows = [], 0
        if last is not None and last.num_rows:
            parts.append(finished(last))
        if parts:
            yield from packs(parts)
        seen = np.flatnonzero(total)
        ids, n = [*seen.tolist(), N_WORDS, N_DISTINCT], [*total[seen].astype(np.int64).tolist(), n_words, distinct]
        yield row(pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()))

    return held.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block int, data binary, id long, n long")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Block:
    """The words of one block: a number for each, its count and its ids."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, b: pa.RecordBatch) -> None:
        ids = b.column("ids")
        self.words.append(b.column("word"))
        flat = b"".join(ids.to_pylist())
        self.parts.append((b.column("c").to_numpy(), np.frombuffer(flat, "<i4"), pc.binary_length(ids).to_numpy() // 4))

    def close(self) -> None:
        """Words are numbered by frequency, so that what is asked for most lies together."""
        c, flat, n = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.argsort(-c, kind="stable")
        first = np.cumsum(n, dtype=np.int32) - n
        words = pa.concat_arrays(self.words) if self.words else pa.array([], pa.binary())
        self.number = words.take(pa.array(order))
        self.c, self.n = c[order], n[order].astype(np.int32)
        self.logs = np.log10(self.c + 1.0)
        self.first = np.cumsum(self.n, dtype=np.int32) - self.n
        at = np.repeat(first[order] - self.first, self.n)
        at += np.arange(len(at), dtype=np.int32)
        self.flat = flat[at]
        del self.words, self.parts

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of words of such numbers one after another."""
        k = self.n[at]
        out = np.repeat(self.first[at] - (np.cumsum(k, dtype=np.int32) - k), k)
        out += np.arange(len(out), dtype=np.int32)
        return self.flat[out]


def coded(packs: DataFrame, blocks: DataFrame, n_blocks: int, end_id: int, n_ends: int, below: float) -> DataFrame:
    """The packed documents as IDS, in the same rows. `end_id` and `n_ends`: id and
    count of the end; `below`: log10 of what the base divides counts by."""
    kind = lambda k: F.lit(k).alias("kind")
    rows = packs.where("block is not null").select("block", kind(0), F.lit(0).alias("part"), "data").unionByName(blocks.select("block", kind(1), "part", "data"))
    end = float(np.log10(n_ends + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        block, own, open_, waiting = None, _Block(), True, []
        for b in batches:
            # a partition is one block: its words come first, then its documents
            of, kinds, part = (b.column(c).to_pylist() for c in ("block", "kind", "part"))
            for at, kind in enumerate(kinds):
                row = b.slice(at, 1)
                if of[at] != block:
                    yield from code(waiting, own, block)
                    block, own, open_, waiting = of[at], _Block(), True, []
                if kind == 0:
                    for _, words in unpacked(row):
                        own.add(words)
                    continue
                if open_:
                    own.close()
                    open_ = False
                waiting += [(part[at], s) for _, s in unpacked(row)]
                if sum(s.nbytes for _, s in waiting) >= SCORE_BYTES:
                    yield from code(waiting, own, block)
                    waiting = []
        yield from code(waiting, own, block)

    def code(waiting: list[tuple[int, pa.RecordBatch]], own: _Block, block: int) -> Iterator[pa.RecordBatch]:
        """Words are looked up for all waiting rows at once."""
        if not waiting:
            return
        b = pa.Table.from_batches([s for _, s in waiting]).combine_chunks().to_batches()[0]
        words, n = words_in(b.column("text"))
        at = pc.index_in(words, value_set=own.number)
        if at.null_count:
            raise ValueError("a word of a block without its count")
        at = at.to_numpy()
        del words
        # sums over each text's words; an end after each text keeps sums of empty texts defined
        cuts = np.append(0, np.cumsum(n))
        total_of = lambda x: np.diff(np.append(0, np.cumsum(x))[cuts])
        base = np.array([float(own.logs[at[lo:hi]].sum()) for lo, hi in zip(cuts, cuts[1:])]) + end - (n + 1) * below
        known = total_of(own.c[at] > 0) + (n_ends > 0)
        lengths = total_of(own.n[at]) + 1
        t = pa.table([b.column("doc_id"), b.column("held_out"), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base)], names=IDS[:-1])
        first = 0
        for part, s in waiting:
            last = first + s.num_rows
            ids = own.ids(at[cuts[first] : cuts[last]])
            ids = np.insert(ids, np.cumsum(lengths[first:last] - 1), end_id)
            yield packed_row(block, part, t.slice(first, last - first).append_column("ids", ids_array(ids, lengths[first:last])))
            first = last

    return rows.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "kind", "part").mapInArrow(run, PACKED)


def lm_scores(docs: DataFrame, name: str = WORD_BPE, limit: int = START_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    t = texts_of(docs).withColumn("held_out", held_out())
    size = t.agg(F.sum(F.octet_length("text")).alias("bytes"), F.coalesce(F.sum(F.when(F.col("held_out"), 0).otherwise(1)), F.lit(0)).alias("docs")).first()
    n_blocks = max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES))
    blocks = stored(packed(docs, n_blocks), "packed-texts")
    packs = stored(word_packs(block_words(blocks), name), "word-packs")
    ends = int(size["docs"])
    counts, n_words, n_distinct = subword_counts(packs.where("id is not null").select("id", "n"), name)
    counts[-1] = ends
    v = Vocabulary.of_counts(counts)
    scorer = Scorer(v, Attention(v.n_classes, vocabulary=v), name)
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    ids = stored(coded(packs, blocks, n_blocks, scorer.end, ends, float(np.log10(total + distinct + 1))), "packed-ids")
    scorer = learn_blocks(ids, start(docs, scorer, limit), n_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for _, own in unpacked(b):
                target, lengths = ids_in(own.column("ids"))
                # tables of positions are built for about TOKENS of whole texts at a time
                last = np.cumsum(lengths)
                cuts = [0, *(np.flatnonzero(np.diff(last // TOKENS)) + 1).tolist(), len(last)]
                parts = [scorer.scores_of(target[last[lo] - lengths[lo] : last[hi - 1]], lengths[lo:hi]) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]
                more = [pa.array(np.full(own.num_rows, total), pa.int64()), own.column("base_score"), pa.array(np.concatenate(parts))]
                yield pa.record_batch([*[own.column(c) for c in IDS[:4]], *more], names=[*IDS[:4], "train_tokens", "base_score", "score"])

    return ids.mapInArrow(run, SCORES)
