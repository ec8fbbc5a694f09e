"""Detectors, calibration and ensembles. A detector adds `raw_score`; higher is
more anomalous."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.operators.baselines import exact_quantiles, melt
from chronosift.operators.learning import learned, training_shards
from chronosift.operators.ranges import running_counts
from chronosift.operators.sequence import SequenceModel  # noqa: F401
from chronosift.session import stored


def greatest(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


# ---- robust statistical ----
def stat_params(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Median and MAD per feature (MAD below 1e-8 counts as 1)."""
    long = melt(train, features)
    med = exact_quantiles(long, [0.5]).select("feature", F.col("q")[0].alias("m"))
    # one row per feature
    dev = long.join(F.broadcast(med), "feature").select("feature", F.abs(F.col("value") - F.col("m")).alias("value"))
    mad = exact_quantiles(dev, [0.5]).select("feature", F.col("q")[0].alias("d")).join(F.broadcast(med), "feature")
    got = {r.feature: (r.m, r.d if r.d >= 1e-8 else 1.0) for r in mad.collect()}
    return {f: got[f] for f in features if f in got}


def stat_score(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Largest |x - median| / MAD, and the first feature that has it."""
    names = list(params)
    zs = [F.abs(F.col(f).cast("double") - m) / d for f, (m, d) in params.items()]
    top = F.array(*zs)
    best = F.array_max(top)
    return df.withColumns({"raw_score": best, "top_feature": F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(top, best).cast("int"))})


# ---- rarity ----
def rarity_tables(train: DataFrame, columns: list[str]) -> tuple[dict[str, DataFrame], int]:
    """Counts per value (null is the value "None") and the number of rows."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return {c: train.groupBy(value(c).alias("v")).agg(F.count("*").alias("n")) for c in columns}, train.count()


def rarity_score(df: DataFrame, tables: dict[str, DataFrame], total: int, penalty: float = 1.0) -> DataFrame:
    """Largest surprisal -ln(count / total) over the columns; an unseen value has ln(total) * penalty."""
    out, parts = df, []
    for c, t in tables.items():
        own = t.select(F.col("v").alias(f"__v_{c}"), F.col("n").alias(f"__n_{c}"))
        out = out.join(own, F.coalesce(F.col(c).cast("string"), F.lit("None")) == F.col(f"__v_{c}"), "left")
        unseen = float(np.log(total)) * penalty if total else 0.0
        parts.append(F.coalesce(-F.log(F.col(f"__n_{c}") / F.lit(float(max(total, 1)))), F.lit(unseen)))
    out = out.withColumn("raw_score", greatest([F.lit(0.0), *parts]))
    return out.drop(*[f"__{k}_{c}" for c in tables for k in "vn"])


# ---- PCA reconstruction ----
class Pca:
    """z-scores; components up to 95 % of variance; score = mean squared
    reconstruction error. All training rows count, by sums of products; a caller
    that wants the first 80 % passes those."""

    def __init__(self, features: list[str], share: float = 0.95):
        self.features, self.share = features, share

    def fit(self, train: DataFrame) -> Pca:
        f = [F.col(c).cast("double") for c in self.features]
        d = len(f)
        # sums of products: d * d numbers whatever the rows
        s = train.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(f)], *[F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]).first()
        n = max(s["n"], 1)
        self.mean = np.array([(s[f"s{i}"] or 0) / n for i in range(d)])
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = (s[f"p{i}_{j}"] or 0) / n - self.mean[i] * self.mean[j]
        std = np.sqrt(np.maximum(np.diag(cov), 0))
        self.std = np.where(std < 1e-8, 1.0, std)
        values, vectors = np.linalg.eigh(cov / np.outer(self.std, self.std))
        order = np.argsort(-values)
        values = np.maximum(values[order], 0)
        k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-12), self.share - 1e-12)) + 1
        self.components = vectors[:, order[: min(k, d)]]
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """As column expressions: z - V V' z, squared and averaged."""
        z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.std)]
        rest = np.eye(len(z)) - self.components @ self.components.T
        err = [reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(z, row)]) for row in rest]
        return df.withColumn("raw_score", reduce(lambda a, b: a + b, [e * e for e in err]) / float(len(z)))


# ---- models in numpy: fitted on all rows, scored where the rows are ----
def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tree_keys(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Rows' 64-bit hashes to one key per row and tree."""
    with np.errstate(over="ignore"):
        starts = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _mixed(rows[:, None] ^ starts[None, :])


def tree_samples(train: DataFrame, order: str, features: list[str], trees: int, size: int, seed: int) -> dict[int, np.ndarray]:
    """Per tree a sample of `size` rows without replacement, drawn from all rows:
    those with the smallest keys. Every task keeps its smallest, the smallest of
    those are the tree's; what reaches the driver is trees * size rows."""
    rows = train.select(F.xxhash64(order).alias("h"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)])
    names = [f"f{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kept = [np.zeros(0, np.uint64)] * trees, [np.zeros((0, len(names)))] * trees
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            fresh = tree_keys(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), trees, seed)
            for t in range(trees):
                k, v = np.concatenate([keys[t], fresh[:, t]]), np.concatenate([kept[t], x])
                least = np.lexsort((*v.T[::-1], k))[:size] if len(k) <= 4 * size else np.argpartition(k, size)[: size + 1]
                if len(least) > size:  # rows of the largest key may tie
                    least = np.flatnonzero(k <= k[least].max())
                    least = least[np.lexsort((*v[least].T[::-1], k[least]))[:size]]
                keys[t], kept[t] = k[least], v[least]
        # as signed numbers in the same order
        signed = (np.concatenate(keys) ^ np.uint64(1 << 63)).view(np.int64)
        x = np.concatenate(kept)
        yield pa.record_batch([pa.array(np.repeat(np.arange(trees, dtype=np.int32), [len(k) for k in keys])), pa.array(signed), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["tree", "key", *names])

    least = rows.mapInArrow(run, "tree int, key long, " + ", ".join(f"{c} double" for c in names))
    least = least.withColumn("at", F.row_number().over(W.partitionBy("tree").orderBy("key", *names))).where(F.col("at") <= size)
    got = least.select("tree", "at", *names).toPandas().sort_values(["tree", "at"])
    return {int(t): g[names].to_numpy(float) for t, g in got.groupby("tree")}


class IsolationForest:
    """Isolation trees; score = 2 ** (-mean path length / expected length)."""

    def __init__(self, features: list[str], trees: int = 100, size: int = 256, seed: int = 42):
        self.features, self.n, self.size, self.seed = features, trees, size, seed

    @staticmethod
    def expected(n: float) -> float:
        if n <= 1:
            return 0.0
        return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    def fit(self, train: DataFrame, order: str) -> IsolationForest:
        samples = tree_samples(train, order, self.features, self.n, self.size, self.seed)
        rng = np.random.default_rng(self.seed)
        self.psi = max((len(x) for x in samples.values()), default=1)
        limit = int(np.ceil(np.log2(max(self.psi, 2))))
        self.trees = []
        for t in range(self.n):
            own = samples.get(t, np.zeros((0, len(self.features))))
            nodes: list[list[float]] = []  # feature, threshold, left, right, length at a leaf
            self._grow(own, 0, limit, rng, nodes)
            self.trees.append(np.array(nodes))
        return self

    def _grow(self, x: np.ndarray, depth: int, limit: int, rng, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + self.expected(len(x))])
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(x[:, f].min(), x[:, f].max())
            low = x[:, f] <= cut
            left = self._grow(x[low], depth + 1, limit, rng, nodes)
            right = self._grow(x[~low], depth + 1, limit, rng, nodes)
            nodes[at] = [f, cut, left, right, 0]
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(64):
                inner = np.flatnonzero(t[at, 0] >= 0)
                if not len(inner):
                    break
                node = t[at[inner]]
                at[inner] = np.where(x[inner, node[:, 0].astype(int)] <= node[:, 1], node[:, 2], node[:, 3]).astype(int)
            total += t[at, 4]
        return 2 ** (-total / len(self.trees) / max(self.expected(self.psi), 1e-9))

    def score(self, df: DataFrame) -> DataFrame:
        return _by_pandas(df, self.features, self.values)


def _by_pandas(df: DataFrame, features: list[str], values) -> DataFrame:
    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(values(np.column_stack([c.fillna(0.0).to_numpy(float) for c in cols])))

    return df.withColumn("raw_score", score(*[F.col(c).cast("double") for c in features]))


class _Dense:
    """The autoencoder's layers (ReLU between them) over one flat vector of weights."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.width = sizes, sizes[0]
        self.size = sum(a * b + b for a, b in zip(sizes, sizes[1:]))

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([p for a, b in zip(self.sizes, self.sizes[1:]) for p in (rng.normal(0, (2 / a) ** 0.5, a * b), np.zeros(b))])

    def _layers(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _forward(self, theta: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        acts, layers = [x], self._layers(theta)
        for i, (w, b) in enumerate(layers):
            y = acts[-1] @ w + b
            acts.append(np.maximum(y, 0) if i < len(layers) - 1 else y)
        return acts

    def examples(self, x: np.ndarray, shard: int = 0) -> np.ndarray:
        return x

    def errors(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((self._forward(theta, x)[-1] - x) ** 2).mean(1)

    def error(self, theta: np.ndarray, x: np.ndarray) -> float:
        return float(self.errors(theta, x).sum())

    def gradient(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        acts, layers, out = self._forward(theta, x), self._layers(theta), []
        d = 2 * (acts[-1] - x) / x.size
        for i in reversed(range(len(layers))):
            out += [d.sum(0), (acts[i].T @ d).ravel()]
            d = (d @ layers[i][0].T) * (acts[i] > 0)
        return np.concatenate(out[::-1])


class Autoencoder:
    """d - hidden - latent - hidden - d with ReLU and squared error, learned from
    the first `1 - later` of the rows, in order; the later ones choose among the
    rounds' weights and end the rounds when they no longer get better."""

    def __init__(self, features: list[str], hidden: int = 32, latent: int = 8, rounds: int = 30, rate: float = 1e-3, batch: int = 256, later: float = 0.2, patience: int = 5, seed: int = 42):
        self.features, self.sizes = features, [len(features), hidden, latent, hidden, len(features)]
        self.rounds, self.rate, self.batch, self.later, self.patience, self.seed = rounds, rate, batch, later, patience, seed

    def fit(self, train: DataFrame, order: str) -> Autoencoder:
        net = _Dense(self.sizes)
        shards, self.mean, self.std = training_shards(train, order, self.features, 1 - self.later)
        self.theta, self.history = learned(shards, net, net.start(self.seed), self.rounds, self.rate, self.batch, self.patience, self.seed)
        return self

    def values(self, x: np.ndarray) -> np.ndarray:
        return _Dense(self.sizes).errors(self.theta, (x - self.mean) / self.std)

    def score(self, df: DataFrame) -> DataFrame:
        return _by_pandas(df, self.features, self.values)


# ---- calibration and ensembles ----
def ecdf_table(train_scores: DataFrame, column: str = "raw_score", more: DataFrame | None = None) -> DataFrame:
    """score, at_most, total: how many training scores are at most this one, per
    distinct score of the training rows, and of `more` (score) where given. Sums
    run within ranges of distinct scores and over the ranges' totals."""
    c = train_scores.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("score")).agg(F.count("*").alias("n"))
    if more is not None:
        c = c.unionByName(more.where("score IS NOT NULL").select("score").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("score").agg(F.sum("n").alias("n"))
    return running_counts(c, [], "score", {"n": "at_most"}).select("score", "at_most", F.col("n_total").alias("total"))


def calibrate(df: DataFrame, train_scores: DataFrame, column: str = "raw_score", out: str = "evidence") -> DataFrame:
    """Evidence = share of training scores at most as high (right-continuous).
    It is looked up per distinct score and joined back by equality, a join that
    AQE splits where many rows share a score."""
    table = stored(ecdf_table(train_scores, column, df.select(F.col(column).alias("score"))), "ecdf")
    table = table.select(F.col("score").alias("__score"), (F.col("at_most") / F.col("total")).alias(out))
    return df.join(table.hint("merge"), F.col(column) == F.col("__score"), "left").drop("__score")


def ensemble(df: DataFrame, evidence: dict[str, str], strategy: str = "max", weights: dict[str, float] | None = None, thresholds: dict[str, float] | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """evidence: detector -> column. Adds ensemble evidence, flag (at the least
    threshold), agreement, disagreement, the first top detector and its category."""
    names = list(evidence)
    cols = [F.col(c) for c in evidence.values()]
    th = thresholds or dict.fromkeys(names, 0.95)
    if strategy == "max":
        e = greatest(cols)
    elif strategy == "mean":
        e = reduce(lambda a, b: a + b, cols) / float(len(cols))
    elif strategy == "weighted":
        if not weights or set(weights) != set(names):
            raise ValueError("weights must name the detectors")
        total = sum(weights.values())
        e = reduce(lambda a, b: a + b, [c * (weights[n] / total) for n, c in zip(names, cols)])
    else:
        raise ValueError(strategy)
    arr = F.array(*cols)
    top = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, F.array_max(arr)).cast("int"))
    agree = reduce(lambda a, b: a + b, [F.when(c >= th[n], 1).otherwise(0) for n, c in zip(names, cols)])
    out = df.withColumns({
        "ensemble_evidence": e, "ensemble_flagged": e >= min(th.values()), "detector_agreement": agree,
        "detector_disagreement": F.array_max(arr) - F.array_min(arr), "top_detector": top,
    })
    cat = categories or TAXONOMY
    mapping = F.create_map(*[F.lit(x) for kv in cat.items() for x in kv])
    return out.withColumn("primary_category", mapping[F.col("top_detector")])


#: Evidence category of each detector.
TAXONOMY = {"statistical": "statistical", "rarity": "novelty", "pca": "reconstruction", "isolation_forest": "behavioural", "autoencoder": "reconstruction", "sequence": "temporal"}
