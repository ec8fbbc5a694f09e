"""A causal LSTM that predicts each window from those before it, and scores
averaged over all sequences that cover a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.operators.learning import PLACE, SHARD, learned, placed, training_shards
from chronosift.operators.windowing import bucketed_frames


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Lstm:
    """One layer of gates (input, forget, cell, output) and a linear readout of
    its state at every place; weights are one flat vector. Examples are
    sequences of `length` + 1 windows: the state after each of the first
    `length` predicts the window that follows."""

    def __init__(self, width: int, hidden: int, length: int, shard: int = SHARD):
        self.width, self.hidden, self.length, self.shard = width, hidden, length, shard
        self.shapes = [(width, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,), (hidden, width), (width,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        return np.random.default_rng(seed).uniform(-1, 1, self.size) / self.hidden**0.5

    def _parts(self, theta: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(theta[at : at + n].reshape(s))
            at += n
        return out

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: sequences, places, features. Predictions of the next window at
        every place, and what the gradient needs."""
        w, u, b, v, c0 = self._parts(theta)
        k, steps = self.hidden, []
        h = c = np.zeros((len(x), k))
        out = np.empty(x.shape)
        for t in range(x.shape[1]):
            z = x[:, t] @ w + h @ u + b
            i, f, g, o = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), np.tanh(z[:, 2 * k : 3 * k]), _sigmoid(z[:, 3 * k :])
            before = (h, c)
            c = f * c + i * g
            top = np.tanh(c)
            h = o * top
            out[:, t] = h @ v + c0
            steps.append((*before, i, f, g, o, top, h))
        return out, steps

    def examples(self, x: np.ndarray, shard: int = 0) -> np.ndarray:
        """Sequences that begin in the shard."""
        if len(x) <= self.length:
            return np.zeros((0, self.length + 1, self.width))
        return np.lib.stride_tricks.sliding_window_view(x, self.length + 1, axis=0)[: self.shard].transpose(0, 2, 1)

    def errors(self, theta: np.ndarray, sequences: np.ndarray) -> np.ndarray:
        """Mean squared error per sequence and place."""
        out = [((self.forward(theta, s[:, :-1])[0] - s[:, 1:]) ** 2).mean(2) for s in (sequences[i : i + 512] for i in range(0, len(sequences), 512))]
        return np.concatenate(out) if out else np.zeros((0, self.length))

    def error(self, theta: np.ndarray, sequences: np.ndarray) -> float:
        return float(self.errors(theta, sequences).mean(1).sum())

    def gradient(self, theta: np.ndarray, sequences: np.ndarray) -> np.ndarray:
        """Of the mean squared error, by backpropagation through time."""
        w, u, b, v, _ = self._parts(theta)
        x, y = sequences[:, :-1], sequences[:, 1:]
        out, steps = self.forward(theta, x)
        d = 2 * (out - y) / out.size
        dw, du, db, dv = np.zeros_like(w), np.zeros_like(u), np.zeros_like(b), np.zeros_like(v)
        dh = dc = np.zeros((len(x), self.hidden))
        for t in reversed(range(x.shape[1])):
            h0, c_before, i, f, g, o, top, h = steps[t]
            dv += h.T @ d[:, t]
            dh = dh + d[:, t] @ v.T
            dc = dc + dh * o * (1 - top**2)
            dz = np.hstack([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dc * i * (1 - g**2), dh * top * o * (1 - o)])
            dw += x[:, t].T @ dz
            du += h0.T @ dz
            db += dz.sum(0)
            dh, dc = dz @ u.T, dc * f
        return np.concatenate([dw.ravel(), du.ravel(), db, dv.ravel(), d.sum((0, 1))])


def overlapping_scores(df: DataFrame, order: str, features: list[str], length: int, errors: Callable[[np.ndarray], np.ndarray], out: str = "raw_score", shard: int = SHARD) -> DataFrame:
    """Every sequence of `length` rows predicts the rows one place on; a row's
    score is the mean of its errors over all sequences that cover it, 0 where
    none does. errors: sequences (n, length + 1, features) to (n, length).

    Sequences belong to the shard they begin in; a shard sums its errors by row,
    and the few rows that two shards cover meet in the aggregation."""
    rows = placed(df.withColumns({f"__f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)}), order, [f"__f{i}" for i in range(len(features))])
    cols = [f"__f{i}" for i in range(len(features))]
    spread = rows.select(F.explode(F.array_distinct(F.array(F.floor(F.col(PLACE) / shard), F.floor(F.greatest(F.col(PLACE) - length, F.lit(0)) / shard)))).alias("shard"), PLACE, *cols)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(PLACE)
        x, places = np.column_stack([table.column(c).to_numpy() for c in cols]), table.column(PLACE).to_numpy()
        total, n = np.zeros(len(x)), np.zeros(len(x), np.int64)
        if len(x) > length:
            seen = np.lib.stride_tricks.sliding_window_view(x, length + 1, axis=0)[:shard].transpose(0, 2, 1)
            e = errors(seen)
            for j in range(length):
                total[j + 1 : j + 1 + len(e)] += e[:, j]
                n[j + 1 : j + 1 + len(e)] += 1
        have = n > 0
        return pa.table({"place": places[have], "total": total[have], "n": n[have]}, pa.schema([("place", pa.int64()), ("total", pa.float64()), ("n", pa.int64())]))

    means = spread.groupBy("shard").applyInArrow(run, "place long, total double, n long").groupBy("place").agg((F.sum("total") / F.sum("n")).alias("__mean"))
    scored = rows.join(means.hint("merge"), F.col(PLACE) == F.col("place"), "left")
    return scored.withColumn(out, F.coalesce("__mean", F.lit(0.0))).drop("__mean", "place", PLACE, *cols)


class SequenceModel:
    """Predicts a window from up to `length` windows before it. Score = mean
    squared error of the prediction; without a window before it the score is 0.
    Learns from every sequence of the first `1 - later` of the rows; the later
    ones choose among the rounds' weights."""

    def __init__(self, features: list[str], length: int = 12, hidden: int = 32, rounds: int = 30, rate: float = 1e-3, batch: int = 64, later: float = 0.2, patience: int = 5, seed: int = 42):
        self.features, self.length, self.hidden, self.rounds, self.rate, self.batch, self.later, self.patience, self.seed = features, length, hidden, rounds, rate, batch, later, patience, seed

    def _net(self) -> Lstm:
        return Lstm(len(self.features), self.hidden, self.length)

    def fit(self, train: DataFrame, order: str = "window_id") -> SequenceModel:
        net = self._net()
        shards, self.mean, self.std = training_shards(train, order, self.features, 1 - self.later, self.length)
        self.theta, self.history = learned(shards, net, net.start(self.seed), self.rounds, self.rate, self.batch, self.patience, self.seed)
        return self

    def _last(self, contexts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Error of the window after each context; contexts of one length go together."""
        net, d = self._net(), len(self.features)
        sizes, out = np.array([len(c) // d for c in contexts]), np.zeros(len(y))
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            x = (np.concatenate([contexts[i] for i in at]).reshape(len(at), n, d) - self.mean) / self.std
            out[at] = ((net.forward(self.theta, x)[0][:, -1] - y[at]) ** 2).mean(1)
        return out

    def score(self, df: DataFrame, order: str = "window_id") -> DataFrame:
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for ctx, *cols in parts:
                y = (np.column_stack([c.fillna(0.0).to_numpy(float) for c in cols]) - self.mean) / self.std
                yield pd.Series(self._last([np.asarray(v, float) for v in ctx], y))

        row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        add = lambda d, w: d.withColumn("__ctx", F.flatten(F.collect_list(row).over(w.rowsBetween(-self.length, -1))))
        framed = bucketed_frames(placed(df, order, self.features), add, self.length, key=PLACE)
        return framed.withColumn("raw_score", F.pandas_udf(run, "double")("__ctx", *[F.col(c).cast("double") for c in self.features])).drop("__ctx", PLACE)

    def score_overlapping(self, df: DataFrame, order: str = "window_id") -> DataFrame:
        """Scores averaged over the sequences that cover a window."""
        net = self._net()
        return overlapping_scores(df, order, self.features, self.length, lambda s: net.errors(self.theta, (s - self.mean) / self.std))
