"""Models learned from all training rows, in rounds over shards.

Rows get their place in the order and are packed into shards of bounded size,
which depend on the rows alone. In a round every task begins at the round's
weights, takes one pass over each of its shards, and the shards' weights are
averaged by their examples; the later rows only measure the error, and the
weights with the least one are kept. What is summed are integers (fixed point),
so weights do not depend on how rows lie in partitions or which task ran where.
What reaches the driver in a round is one row per weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.operators.ranges import running_counts
from chronosift.session import stored

#: Rows of a shard.
SHARD = 4096
#: Fixed-point steps of a unit: of weights, and of losses.
WEIGHT_STEPS, LOSS_STEPS = 1 << 32, 1 << 20
PLACE = "__place"


def placed(df: DataFrame, order: str, ties: list[str]) -> DataFrame:
    """`df` with the place of each row in ascending order, from 0; rows of equal
    order stand by `ties`. No task orders more than a range of the rows."""
    counts = df.groupBy(F.col(order).alias("__v")).agg(F.count("*").alias("__n"))
    upto = running_counts(counts, [], "__v", {"__n": "__upto"}).select("__v", (F.col("__upto") - F.col("__n")).alias("__before"))
    within = F.row_number().over(W.partitionBy(order).orderBy(*ties)) - 1
    out = df.join(upto.hint("merge"), F.col(order).eqNullSafe(F.col("__v")))
    return out.withColumn(PLACE, F.col("__before") + within).drop("__v", "__before")


def packed(rows: DataFrame, features: list[str], part, after: int = 0, shard: int = SHARD) -> DataFrame:
    """rows: PLACE and features (doubles). One row per part and shard: part,
    shard, x (its rows in order, doubles as bytes), with the `after` rows that
    follow them in their part."""
    own = F.floor(F.col(PLACE) / shard)
    shards = F.array_distinct(F.array(own, F.floor(F.greatest(F.col(PLACE) - after, F.lit(0)) / shard)))
    spread = rows.select(part.alias("part"), F.explode(shards).alias("shard"), PLACE, *features)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(PLACE)
        x = np.column_stack([table.column(f).to_numpy() for f in features])
        return pa.table({"part": [key[0].as_py()], "shard": [key[1].as_py()], "x": [np.ascontiguousarray(x, float).tobytes()]}, pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("x", pa.binary())]))

    return spread.groupBy("part", "shard").applyInArrow(run, "part int, shard long, x binary")


class Adam:
    """Steps of one pass; its averages begin anew with each pass."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return theta - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def learned(shards: DataFrame, model, theta: np.ndarray, rounds: int, rate: float, batch: int, patience: int, seed: int) -> tuple[np.ndarray, list[list[float]]]:
    """Weights with the least error on part 1 (on part 0 where that is empty),
    and [training error, validation error] at the start of each round.

    model: width; examples(x) gives an array per example; error(theta, examples)
    its sum of mean squared errors; gradient(theta, examples) that of their mean."""
    width, history, best, waited = model.width, [], (np.inf, theta), 0
    for r in range(rounds + 1):
        last = r == rounds

        def run(batches: Iterator[pa.RecordBatch], theta=theta, r=r, last=last) -> Iterator[pa.RecordBatch]:
            weights, sums = np.zeros(len(theta) + 1, np.int64), np.zeros((2, 2), np.int64)
            for b in batches:
                for part, shard, raw in zip(*[b.column(c).to_pylist() for c in ("part", "shard", "x")]):
                    own = model.examples(np.frombuffer(raw).reshape(-1, width), shard)
                    if not len(own):
                        continue
                    sums[part] += (round(model.error(theta, own) * LOSS_STEPS), len(own))
                    if part or last:
                        continue
                    moved, adam = theta, Adam(len(theta), rate)
                    order = np.random.default_rng((seed, r, shard)).permutation(len(own))
                    for at in range(0, len(order), batch):
                        moved = adam.step(moved, model.gradient(moved, own[order[at : at + batch]]))
                    weights[:-1] += len(own) * np.rint(moved * WEIGHT_STEPS).astype(np.int64)
                    weights[-1] += len(own)
            values = np.concatenate([weights, sums.ravel()])
            yield pa.record_batch([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])

        got = shards.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
        total = [0] * (len(theta) + 5)
        for at, v in got:
            total[at] = int(v)
        errors = [s / LOSS_STEPS / n if n else float("nan") for s, n in (total[-4:-2], total[-2:])]
        history.append(errors)
        judged = errors[1] if total[-1] else errors[0]
        waited += 1
        if judged < best[0]:
            best, waited = (judged, theta), 0
        if last or waited > patience or not total[-5]:
            break
        theta = np.array([t / total[-5] / WEIGHT_STEPS for t in total[:-5]])
    return best[1], history


def training_shards(train: DataFrame, order: str, features: list[str], share: float, after: int = 0, shard: int = SHARD) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Shards of the standardised rows (part 0: the first `share` of them, part
    1: the later ones), and mean and deviation of the first part."""
    rows = train.select(order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    rows = stored(placed(rows, order, features).select(PLACE, *features), "training-rows")
    split = max(1, int(rows.count() * share))
    s = rows.where(F.col(PLACE) < split).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, std = (np.array([s[f"{n}{i}"] or 0.0 for i in range(len(features))]) for n in "ms")
    std = np.where(std < 1e-8, 1.0, std)
    z = rows.select(PLACE, *[((F.col(c) - float(m)) / float(d)).alias(c) for c, m, d in zip(features, mean, std)])
    return stored(packed(z, features, (F.col(PLACE) >= split).cast("int"), after, shard), "shards"), mean, std
