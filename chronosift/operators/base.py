"""The common interface of detectors and transforms: fitted once on rows before
a bound, frozen, saved and loaded."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators import detectors as D
from chronosift.operators.baselines import ImmutableBaselineError
from chronosift.operators.windowing import guard_bounds
from chronosift.sources.extraction import read_text, write_text

FORMAT = 1


class NotFrozenError(RuntimeError):
    """Something that isn't fitted is used."""


class Transformation(ABC):
    """A column function over frozen statistics: refuses a baseline that isn't frozen."""

    def __init__(self, suite):
        if not suite.frozen:
            raise NotFrozenError(f"{suite.path} is not frozen")
        self.suite = suite

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...


class Detector(ABC):
    """fit guards the bound and freezes; score adds raw_score (higher is more
    anomalous); predict adds evidence against the training scores and a flag;
    explain adds a sentence; save and load keep state and training scores."""

    name = ""
    #: Feature columns of the training rows' order, where the model needs one.
    order = "window_id"

    def __init__(self, features: list[str], threshold: float = 0.95):
        self.features, self.threshold, self.frozen = list(features), threshold, False
        self.ecdf: DataFrame | None = None

    def fit(self, train: DataFrame, ts: str | None = None, bound: str | None = None) -> Detector:
        if self.frozen:
            raise ImmutableBaselineError(self.name)
        if ts and bound:
            guard_bounds(train, ts, bound)
        self._fit(train)
        self.frozen = True
        self.ecdf = D.stored(self.score(train).groupBy("raw_score").agg(F.count("*").alias("n")), f"scores-{self.name}")
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if not self.frozen:
            raise NotFrozenError(self.name)
        return self._score(df)

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.score(df)
        counts = D.running_counts(self.ecdf.unionByName(scored.select("raw_score").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("raw_score").agg(F.sum("n").alias("n")), [], "raw_score", {"n": "upto"})
        looked_up = D.stored(counts.select(F.col("raw_score").alias("__score"), (F.col("upto") / F.col("n_total")).alias("evidence")), "evidence")
        out = scored.join(looked_up.hint("merge"), F.col("raw_score") == F.col("__score"), "left").drop("__score")
        return out.withColumn("flagged", F.col("evidence") >= self.threshold)

    def explain(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("explanation", self._sentence())

    def save(self, spark: SparkSession, path: str) -> None:
        if not self.frozen:
            raise NotFrozenError(self.name)
        self.ecdf.write.mode("overwrite").parquet(f"{path}/scores")
        self._save_tables(path)
        head = {"format": FORMAT, "name": self.name, "features": self.features, "threshold": self.threshold}
        write_text(spark, f"{path}/detector.json", json.dumps(head | {"state": self.state()}, sort_keys=True))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        text = read_text(spark, f"{path}/detector.json")
        if text is None:
            raise FileNotFoundError(path)
        head = json.loads(text)
        verify([head])
        out = KINDS[head["name"]](head["features"], head["threshold"])
        out._load_tables(spark, path)
        out.restore(head["state"])
        out.ecdf, out.frozen = spark.read.parquet(f"{path}/scores"), True
        return out

    def _sentence(self) -> Column:
        return F.format_string(f"{self.name}: score %.4f", "raw_score")

    def _save_tables(self, path: str) -> None: ...

    def _load_tables(self, spark: SparkSession, path: str) -> None: ...

    @abstractmethod
    def _fit(self, train: DataFrame) -> None: ...

    @abstractmethod
    def _score(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def state(self) -> dict: ...

    @abstractmethod
    def restore(self, state: dict) -> None: ...


class Statistical(Detector):
    name = "statistical"

    def _fit(self, train: DataFrame) -> None:
        self.params = D.stat_params(train, self.features)

    def _score(self, df: DataFrame) -> DataFrame:
        return D.stat_score(df, self.params)

    def _sentence(self) -> Column:
        return F.concat(F.lit("Driven by "), F.col("top_feature"), F.format_string(" (Robust Z-Score: %.2f)", "raw_score"))

    def state(self) -> dict:
        return {"params": [[f, *p] for f, p in self.params.items()]}

    def restore(self, state: dict) -> None:
        self.params = {f: (m, d) for f, m, d in state["params"]}


class Rarity(Detector):
    """Its counts per value are tables of their own: they grow with the values."""

    name = "rarity"

    def _fit(self, train: DataFrame) -> None:
        self.tables, self.total = D.rarity_tables(train, self.features)

    def _score(self, df: DataFrame) -> DataFrame:
        return D.rarity_score(df, self.tables, self.total)

    def _save_tables(self, path: str) -> None:
        for i, c in enumerate(self.features):
            self.tables[c].write.mode("overwrite").parquet(f"{path}/values-{i}")

    def _load_tables(self, spark: SparkSession, path: str) -> None:
        self.tables = {c: spark.read.parquet(f"{path}/values-{i}") for i, c in enumerate(self.features)}

    def state(self) -> dict:
        return {"total": self.total}

    def restore(self, state: dict) -> None:
        self.total = state["total"]


class _Model(Detector):
    """Over one of the numpy models: its arrays and numbers are the state."""

    kind: type
    ordered = True

    def __init__(self, features: list[str], threshold: float = 0.95):
        super().__init__(features, threshold)
        self.model = self.kind(self.features)

    def _fit(self, train: DataFrame) -> None:
        self.model.fit(train, self.order) if self.ordered else self.model.fit(train)

    def _score(self, df: DataFrame) -> DataFrame:
        return self.model.score(df)

    def state(self) -> dict:
        plain = lambda x: {"array": x.tolist()} if isinstance(x, np.ndarray) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x.item() if isinstance(x, np.generic) else x
        return {k: plain(v) for k, v in vars(self.model).items()}

    def restore(self, state: dict) -> None:
        back = lambda x: np.array(x["array"], float) if isinstance(x, dict) else [back(y) for y in x] if isinstance(x, list) else x
        vars(self.model).update({k: back(v) for k, v in state.items()})


class PcaDetector(_Model):
    name, kind, ordered = "pca", D.Pca, False


class IsolationForestDetector(_Model):
    name, kind = "isolation_forest", D.IsolationForest


class AutoencoderDetector(_Model):
    name, kind = "autoencoder", D.Autoencoder


class SequenceDetector(_Model):
    name, kind = "sequence", D.SequenceModel


KINDS = {k.name: k for k in (Statistical, Rarity, PcaDetector, IsolationForestDetector, AutoencoderDetector, SequenceDetector)}


def verify(heads: list[dict], features: list[str] | None = None) -> None:
    """All that doesn't fit in saved detectors, in one error: format, kind, features other than the pipeline's."""
    wrong = []
    for h in heads:
        if h.get("format") != FORMAT:
            wrong.append(f"{h.get('name')}: format {h.get('format')}, expected {FORMAT}")
        if h.get("name") not in KINDS:
            wrong.append(f"unknown detector {h.get('name')}")
        if features is not None and not set(h.get("features", [])) <= set(features):
            wrong.append(f"{h.get('name')}: features {sorted(set(h.get('features', [])) - set(features))} are missing")
    if wrong:
        raise ValueError("; ".join(wrong))


def sample_gate(detectors: list[Detector], df: DataFrame, rows: int = 100) -> dict[str, tuple[float, float, float]]:
    """Score a few rows with every detector before a long run: least, largest and
    mean score of each; an error if one has no finite score."""
    part, out = df.limit(rows), {}
    for d in detectors:
        r = d.score(part).agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"), F.avg("raw_score").alias("mean"), F.count(F.when(F.col("raw_score").isNull() | F.isnan("raw_score"), 1)).alias("bad")).first()
        if r.lo is None or r.bad:
            raise ValueError(f"{d.name}: {r.bad} rows without a score")
        out[d.name] = (r.lo, r.hi, r.mean)
    return out
