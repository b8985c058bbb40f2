"""Frozen reference spaces: a layer and, for `pca`, axes, fitted once, named by a fingerprint and replayed on other tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import COFACTOR
from .layers import Layer, fit_layer
from .space import Axes, fit_axes

KINDS = ("scaled", "pca")
VERSION = 1


def _digest(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Space:
    """How raw features become coordinates; project() is a projection, so it works on batch and streaming tables alike."""

    kind: str
    layer: Layer
    axes: Axes | None = None
    rows_fitted: int = 0
    mean: tuple[float, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return self.layer.features

    @property
    def names(self) -> tuple[str, ...]:
        """The coordinates' columns."""
        if self.axes is None:
            return tuple(f"{f}__scaled" for f in self.features)
        return tuple(f"pc{k + 1}" for k in range(self.axes.loadings.shape[1]))

    @property
    def fingerprint(self) -> str:
        axes = "" if self.axes is None else _digest("|".join(self.axes.features), np.asarray(self.axes.mean).tobytes().hex(), np.ascontiguousarray(self.axes.loadings).tobytes().hex())
        return _digest(VERSION, self.kind, self.layer.fingerprint, axes, len(self.names), "|".join(self.features))

    def project(self, df: DataFrame) -> DataFrame:
        """df with the coordinates' columns, replaced where they exist; never refits."""
        own = {f: f"_space_{i}" for i, f in enumerate(self.features)}
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        scaled = df.drop(*[c for c in self.names if c in df.columns]).withColumns({own[f]: c for f, c in self.layer.columns().items()})
        if self.axes is None:
            made = {n: F.col(own[f]) for n, f in zip(self.names, self.features, strict=True)}
        else:
            made = {}
            for k, n in enumerate(self.names):
                made[n] = sum(((F.col(own[f]) - F.lit(float(m))) * F.lit(float(w)) for f, m, w in zip(self.features, self.axes.mean, self.axes.loadings[:, k], strict=True)), F.lit(0.0))
        return scaled.withColumns(made).drop(*own.values())

    def matches(self, said: dict) -> bool:
        """Whether a dataset's metadata say that its coordinates are of this very space."""
        return said.get("space_fingerprint") == self.fingerprint

    def stated(self) -> dict:
        """Metadata for a dataset that holds coordinates of this space."""
        return {"space_fingerprint": self.fingerprint, "space": self.to_json()}

    def gap(self, stored: DataFrame) -> float:
        """Largest difference between stored coordinates and those projected anew from the raw features, over all rows; one aggregation."""
        kept = {n: f"_stored_{i}" for i, n in enumerate(self.names)}
        again = self.project(stored.withColumns({v: F.col(n) for n, v in kept.items()}))
        worst = again.agg(F.max(F.greatest(*[F.abs(F.col(n) - F.col(v)) for n, v in kept.items()], F.lit(0.0)))).first()[0]
        return 0.0 if worst is None else float(worst)

    def to_json(self) -> str:
        axes = None
        if self.axes is not None:
            axes = {"features": list(self.axes.features)} | {c: np.asarray(getattr(self.axes, c)).tolist() for c in ("mean", "loadings", "explained", "values")}
        return json.dumps({"version": VERSION, "kind": self.kind, "layer": asdict(self.layer), "axes": axes, "rows_fitted": self.rows_fitted, "mean": list(self.mean), "fingerprint": self.fingerprint})

    @staticmethod
    def from_json(text: str) -> Space:
        """Raises ValueError for another version, and if the parameters don't give the fingerprint that was written with them."""
        data = json.loads(text)
        if data["version"] != VERSION:
            raise ValueError(f"a space of version {data['version']}; this is {VERSION}")
        axes = data["axes"] and Axes(tuple(data["axes"]["features"]), *(np.array(data["axes"][c]) for c in ("mean", "loadings", "explained", "values")))
        space = Space(data["kind"], Layer(**data["layer"] | {"features": tuple(data["layer"]["features"])}), axes or None, data["rows_fitted"], tuple(data["mean"]))
        if space.fingerprint != data["fingerprint"]:
            raise ValueError("the parameters are not those of the fingerprint")
        return space


def fit_space(df: DataFrame, features: Sequence[str], kind: str = "pca", transform: str = "none", norm: str = "zscore_col", components: int | float | None = 10, weight: str | None = None, cofactor: float = COFACTOR) -> Space:
    """A space fitted on all rows without missing features.

    `components` of a pca space: a number of axes, or a share of the variance below 1 that they
    reach together; None for all. `weight` is a column of row weights for means and axes. The
    space's `mean` is the table's mean in its coordinates.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    features = tuple(features)
    known = df.dropna(subset=list(features))
    layer = fit_layer(known, features, transform, norm, cofactor)
    axes = None
    if kind == "pca":
        whole = components is None or isinstance(components, float)
        axes = fit_axes(layer.apply(known), features, len(features) if whole else int(components), weight)
        if isinstance(components, float):
            kept = axes.components_for(components)
            axes = Axes(axes.features, axes.mean, axes.loadings[:, :kept], axes.explained[:kept], axes.values[:kept])
    space = Space(kind, layer, axes)
    mean = (lambda c: F.sum(F.col(weight) * F.col(c)) / F.sum(weight)) if weight else F.avg
    got = space.project(known).agg(F.count("*").alias("n"), *[mean(c).alias(f"m{i}") for i, c in enumerate(space.names)]).first()
    return Space(kind, layer, axes, got["n"], tuple(float(got[f"m{i}"]) if got[f"m{i}"] is not None else 0.0 for i in range(len(space.names))))


def offsets(df: DataFrame, space: Space, name: str = "offset") -> DataFrame:
    """df with the distance of each row's coordinates to the space's mean."""
    apart = [F.pow(F.col(c) - F.lit(float(m)), 2.0) for c, m in zip(space.names, space.mean, strict=True)]
    return space.project(df).withColumn(name, F.sqrt(sum(apart, F.lit(0.0))))


def reference_row(df: DataFrame, space: Space, label: str, column: str = "unique_subject_ID") -> DataFrame:
    """df with a synthetic row, labelled in `column`: the mean of each feature over the rows without missing features, other columns null."""
    known = df.dropna(subset=list(space.features))
    mean = known.agg(*[F.avg(F.col(f).cast("double")).cast(df.schema[f].dataType).alias(f) for f in space.features])
    return df.unionByName(mean.withColumn(column, F.lit(label)), allowMissingColumns=True)


def fit_reference(df: DataFrame, features: Sequence[str], share: float | int = 0.95, weight: str | None = None) -> Space:
    """The frozen reference of the absolute indices: z-scores and the axes that reach `share` of the variance (or so many axes), of at least 10 rows."""
    if df.limit(10).count() < 10:
        raise ValueError("a reference needs at least 10 rows")
    return fit_space(df, features, "pca", components=share, weight=weight)


def absolute(df: DataFrame, group: str, space: Space, least: int = 5) -> DataFrame:
    """Per group of `least` rows or more, in the space: rows, offset (norm of the centroid), distances to the origin, and median distance to the own centroid.

    Rows with a missing feature are left out, so that counts are of the rows measured.
    """
    known = space.project(df.dropna(subset=[group, *space.features]))
    far = known.withColumn("_o", F.sqrt(sum((F.col(c) * F.col(c) for c in space.names), F.lit(0.0))))
    centres = far.groupBy(group).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(space.names)]).where(F.col("_n") >= least)
    apart = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_m{i}"), 2.0) for i, c in enumerate(space.names)), F.lit(0.0)))
    offset = F.sqrt(sum((F.pow(F.first(f"_m{i}"), 2.0) for i in range(len(space.names))), F.lit(0.0)))
    return far.join(centres, group).withColumn("_d", apart).groupBy(group).agg(
        F.count("*").alias("n"), offset.alias("amhi_offset"), F.median("_o").alias("amhi_median"), F.avg("_o").alias("amhi_mean"),
        F.stddev_pop("_o").alias("amhi_std"), F.percentile("_o", 0.25).alias("amhi_q25"), F.percentile("_o", 0.75).alias("amhi_q75"), F.median("_d").alias("mhi_d_absolute"),
    )
