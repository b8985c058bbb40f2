"""Whitening of embeddings on the principal components of all of them.

First pass: the sums of the components as whole numbers, exact. Second pass: outer products of
centred vectors, a block of rows by one matrix product at a time; treeAggregate merges what the
tasks found. The driver gets one matrix of the vectors' dimension squared, decomposes it, and the
projection (dimension times components) is broadcast. A third pass measures the covariance of
what the projection gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Steps per unit, and what is added, when an entry becomes a whole number; beyond 2^62 steps it stays there.
STEPS, SHIFT, _MOST = 64, 1_000_000, 1 << 62
#: Entries of a block of rows.
_BLOCK = 1 << 20


class Moments(NamedTuple):
    """Rows, their mean, and the sum of outer products centred on it."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        off = other.mean - self.mean
        return Moments(n, self.mean + off * (other.n / n), self.products + other.products + np.outer(off, off) * (self.n * other.n / n))


class Projection(NamedTuple):
    """What whitens vectors of one dimension: n and sums S of the fit list, eigenvectors in columns, eigenvalues, trace, and the measured error."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, each difference rounded once: S/n is split into a whole part and a fraction."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One row per vector; a component without variance is NaN."""
        scale = np.full(len(self.values), np.nan)
        some = self.values > 0
        scale[some] = 1 / np.sqrt(self.values[some])
        return self.centred(x) @ self.axes * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n*x - S)^2, exact however large."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - int(w) * self.n for s, w in zip(self.sums, whole, strict=True)]
        off = x - whole
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most < 1 << 31 and most * most * max(1, x.shape[1]) < 1 << 63:
            return (((off * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1)).tolist()
        return [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off]


def usable(vector: str):
    """Not null, and without null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def _blocks(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole numbers of the vectors, block by block and one length at a time, with their places in the batch."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        step = max(1, _BLOCK // max(1, int(d)))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            values = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), int(d))
            yield own, np.clip(np.floor(STEPS * values), -_MOST, _MOST).astype(np.int64) + SHIFT


def _gathered(vectors: DataFrame, of_blocks, merge) -> dict[int, object]:
    """of_blocks(x) of every block, merged by the vectors' length first in its task and then up a tree of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        own: dict[int, object] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                got = of_blocks(x)
                own[x.shape[1]] = merge(own[x.shape[1]], got) if x.shape[1] in own else got
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], type=pa.binary())], names=["state"])
        give_back()

    def merged(one: dict, two: dict) -> dict:
        for d, got in two.items():
            one[d] = merge(one[d], got) if d in one else got
        return one

    def add(own: dict, row) -> dict:
        import pickle

        return merged(own, pickle.loads(row["state"]))

    return vectors.mapInArrow(partial, "state binary").rdd.treeAggregate({}, add, merged, depth=2)


def _sums(x: np.ndarray) -> tuple[int, list[int]]:
    """Rows and exact sums: high and low halves apart, so that no sum leaves 64 bits."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return len(x), [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def _moments(m: np.ndarray) -> Moments:
    mean = m.mean(axis=0)
    off = m - mean
    return Moments(len(m), mean, off.T @ off)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 32, most: int = 8192) -> dict[int, Projection]:
    """Projections by length, fitted on all usable vectors; vectors must hold usable ones only.

    `most` bounds the dimension, for the driver holds a square matrix of it; longer vectors raise ValueError.
    """
    only = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    longest = only.agg(F.max(F.size("v"))).first()[0]
    if longest is not None and longest > most:
        raise ValueError(f"vectors of {longest} entries; at most {most} can be whitened")
    sums = _gathered(only, _sums, lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)]))
    centre = {d: Projection(n, s, np.zeros((d, 0)), np.zeros(0), 0.0, None) for d, (n, s) in sums.items()}
    products = _gathered(only, lambda x: (c := centre[x.shape[1]].centred(x)).T @ c, np.add)
    made = {}
    for d, own in centre.items():
        values, axes = np.linalg.eigh(products[d] / own.n)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        floor = max(values[0], 0) * d * np.finfo(float).eps if d else 0  # what rounding leaves of no variance
        made[d] = own._replace(axes=axes, values=np.where(values > floor, values, 0.0), trace=float(np.trace(products[d]) / own.n))
    live = {d: p for d, p in made.items() if (p.values > 0).any()}
    if live:
        # treeAggregate ships these in its closure: dimension times components for each length
        def of_blocks(x: np.ndarray):
            p = live.get(x.shape[1])
            return _moments(p.whitened(x)[:, p.values > 0]) if p else Moments(len(x), np.zeros(0), np.zeros((0, 0)))

        for d, got in _gathered(only, of_blocks, Moments.plus).items():
            if d in live:
                made[d] = made[d]._replace(identity_error=float(np.abs(got.products / got.n - np.eye(len(got.mean))).max()))
    return made


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32, most: int = 8192) -> DataFrame:
    """One row per usable vector: id, n, deviation decimal(38,0), whitened and explained arrays of up to `components` doubles, identity_error.

    Every entry c becomes the whole number floor(64*c) + 1000000. Vectors that are null or hold
    null, NaN or infinite entries give no row. Vectors of different lengths are spaces of their
    own, each with its n and components; a vector of length zero has none. A component without
    variance (fewer vectors than dimensions, constant entries, one vector) has a null whitened
    value and is left out of identity_error, null where none has variance; explained is null where
    the whole space has none. Null ids and repeated rows stay; an empty table gives no rows; other
    columns don't matter. A deviation of over 38 digits is null.
    """
    clean = vectors.where(usable(vector)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    projections = clean.sparkSession.sparkContext.broadcast(fit(clean, "v", components, most))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for rows, x in _blocks(batch.column(1)):
                p = projections.value[x.shape[1]]
                white = p.whitened(x)
                k = white.shape[1]
                lists = np.arange(0, k * len(rows) + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(rows) + 1, np.int32)
                share = p.values / p.trace if p.trace > 0 else np.full(k, np.nan)
                deviations = [Decimal(v) if v < 10**38 else None for v in p.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.full(len(rows), p.n)),
                        pa.array(deviations, type=pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(white.ravel(), from_pandas=True)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(np.tile(share, len(rows)), from_pandas=True)),
                        pa.array([p.identity_error] * len(rows), type=pa.float64()),
                    ],
                    names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        give_back()

    kind = clean.schema["id"].dataType.simpleString()
    made = clean.select("id", F.col("v").cast("array<double>")).mapInArrow(
        project, f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    )
    return made.withColumnRenamed("id", id_col)
