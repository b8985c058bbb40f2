"""Regressors that are fitted by gradients summed over all rows: a multilayer perceptron and support vector regression.

Each step of the fit is one job: every partition adds up the loss and gradient of its rows, the
sums are merged in a tree, and the driver, which holds the parameters alone, takes an L-BFGS step.
So no task or driver ever holds the rows, and a fit costs as many scans as it takes steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (parameters, x, y) to the sum of the losses of the rows and its gradient.
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]
REGRESSORS = ("MLP", "SVM")
#: Steps of L-BFGS that are remembered.
MEMORY = 10


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def summed(rows: DataFrame, loss: Loss, at: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums of loss and gradient over rows (x array<double>, y double)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) + 1)
        for batch in batches:
            if batch.num_rows:
                value, slope = loss(at, _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total[0] += value
                total[1:] += slope
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    total = rows.select("x", "y").mapInArrow(parts, "s array<double>").rdd.map(lambda r: np.asarray(r[0])).treeReduce(np.add)
    return float(total[0]), total[1:]


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with halved steps; ends after `steps`, or once the value falls by less than `tolerance` of itself or the gradient is as small."""
    x = start
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance:
            break
        way, weights = slope.copy(), []
        for s, d in reversed(moves):
            a = s @ way / (s @ d)
            weights.append(a)
            way -= a * d
        if moves:
            s, d = moves[-1]
            way *= (s @ d) / (d @ d)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, d), a in zip(moves, reversed(weights), strict=True):
            way += (a - d @ way / (s @ d)) * s
        down, length = -(slope @ way), 1.0
        for _ in range(20):
            after = x - length * way
            new_value, new_slope = f(after)
            if new_value <= value + 1e-4 * length * down:
                break
            length /= 2
        else:
            break
        s, d = after - x, new_slope - slope
        if s @ d > 1e-12 * (d @ d):
            moves = [*moves[1 - MEMORY :], (s, d)]
        fell = value - new_value
        x, value, slope = after, new_value, new_slope
        if fell <= tolerance * max(abs(value), tolerance):
            break
    return x


def layers_of(at: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, offsets) of each layer, cut from one array."""
    out, k = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((at[k : k + a * b].reshape(a, b), at[k + a * b : k + a * b + b]))
        k += a * b + b
    return out


def perceptron(at: np.ndarray, x: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Values of all layers: rectified inside, linear at the end."""
    values, layers = [x], layers_of(at, sizes)
    for k, (w, b) in enumerate(layers):
        z = values[-1] @ w + b
        values.append(z if k == len(layers) - 1 else np.maximum(z, 0.0))
    return values


def squared_loss(at: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: Sequence[int]) -> tuple[float, np.ndarray]:
    """Half the squared errors of a perceptron, and the gradient by back-propagation."""
    values = perceptron(at, x, sizes)
    back = values[-1] - y[:, None]
    value, slopes = 0.5 * float((back**2).sum()), []
    for (w, _), below in zip(reversed(layers_of(at, sizes)), reversed(values[:-1]), strict=True):
        slopes.append(np.concatenate([(below.T @ back).ravel(), back.sum(axis=0)]))
        back = (back @ w.T) * (below > 0)
    return value, np.concatenate(slopes[::-1])


def tube_loss(at: np.ndarray, x: np.ndarray, y: np.ndarray, epsilon: float) -> tuple[float, np.ndarray]:
    """Squares of what errors of a linear model (weights, then offset) have beyond epsilon."""
    gap = x @ at[:-1] + at[-1] - y
    over = np.sign(gap) * np.maximum(np.abs(gap) - epsilon, 0.0)
    return float((over**2).sum()), 2 * np.append(over @ x, over.sum())


@dataclass(frozen=True)
class GradientModel:
    """A fitted regressor; sizes are those of a perceptron's layers, (width, 1) for a linear model."""

    at: np.ndarray
    sizes: tuple[int, ...]
    centre: float
    scale: float

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `prediction` from its vectors _x."""
        at, sizes, centre, scale = self.at, self.sizes, self.centre, self.scale

        @F.pandas_udf("double")
        def predicted(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_list()) if len(v) else np.empty((0, sizes[0]))
            return pd.Series(perceptron(at, x, sizes)[-1][:, 0] * scale + centre)

        return df.withColumn("prediction", predicted(vector_to_array("_x")))


def fit(train: DataFrame, name: str, hidden: Sequence[int] = (64, 32), penalty: float = 1e-4, cost: float = 1.0, epsilon: float = 0.1, steps: int = 100, seed: int = 42) -> GradientModel:
    """A model of rows (_x vector, _y number), without nulls; labels are centred and scaled by their population SD first.

    MLP: half the mean squared error and `penalty` times half the squared weights. SVM: half the
    squared weights and `cost` times the squares beyond `epsilon` (in SDs of the label), linear in
    _x, so a kernel is a matter of _x. Equal labels give a model of that label; no rows are an
    error. Sums of many partitions are merged in any order, so reruns agree up to rounding.
    """
    if name not in REGRESSORS:
        raise ValueError(f"unknown regressor {name}")
    rows = train.select(vector_to_array("_x").alias("x"), F.col("_y").cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.max(F.size("x")).alias("width")).first()
        if not seen["n"]:
            raise ValueError("no rows to learn from")
        n, centre, scale, width = seen["n"], seen["m"], seen["s"], seen["width"]
        sizes = (width, *hidden, 1) if name == "MLP" else (width, 1)
        if not scale:
            return GradientModel(np.zeros(sum(a * b + b for a, b in zip(sizes, sizes[1:], strict=False))), sizes, centre, 1.0)
        z = rows.withColumn("y", (F.col("y") - F.lit(centre)) / F.lit(scale))
        rng, start, weighs = np.random.default_rng(seed), [], []
        for a, b in zip(sizes, sizes[1:], strict=False):
            bound = np.sqrt(6 / (a + b)) if name == "MLP" else 0.0
            start += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
            weighs += [np.ones(a * b), np.zeros(b)]  # offsets aren't penalised
        mask = np.concatenate(weighs)
        if name == "MLP":
            loss, share = (lambda at, x, y: squared_loss(at, x, y, sizes)), penalty
        else:
            loss, share = (lambda at, x, y: tube_loss(at, x, y, epsilon)), 1 / (n * cost)

        def objective(at: np.ndarray) -> tuple[float, np.ndarray]:
            value, slope = summed(z, loss, at)
            held = mask * at
            return value / n + share * 0.5 * float(held @ held), slope / n + share * held

        return GradientModel(minimise(objective, np.concatenate(start), steps), sizes, centre, scale)
    finally:
        rows.unpersist()
