"""Feature layers: a transform, then a normalisation, whose parameters are fitted once and replayed anywhere."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import COFACTOR

TRANSFORMS = ("none", "arcsinh", "logicle")
NORMALIZATIONS = ("none", "zscore_col", "minmax_col", "l2norm_row", "zscore_col__l2norm_row")


@dataclass(frozen=True)
class Layer:
    """Frozen parameters; apply() is a projection, so it works on batch and streaming tables alike."""

    features: tuple[str, ...]
    transform: str = "none"
    norm: str = "zscore_col"
    cofactor: float = COFACTOR
    scale: dict[str, float] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.transform}__{self.norm}"

    @property
    def fingerprint(self) -> str:
        parts = ["|".join(self.features), self.transform, self.norm, repr(self.cofactor)]
        arrays = [np.array([d.get(f, np.nan) for f in self.features]).tobytes().hex() for d in (self.scale, self.shift, self.spread)]
        return hashlib.sha256("\x1f".join(parts + arrays).encode()).hexdigest()[:12]

    def transformed(self, feature: str) -> Column:
        c = F.col(feature).cast("double")
        if self.transform == "arcsinh":
            return F.asinh(c / F.lit(self.cofactor))
        if self.transform == "logicle":
            return F.asinh(5 * c / F.lit(self.scale[feature]))
        return c

    def columns(self) -> dict[str, Column]:
        out = {f: self.transformed(f) for f in self.features}
        if self.norm != "none" and not self.norm.startswith("l2"):
            out = {f: (c - F.lit(self.shift[f])) / F.lit(self.spread[f]) for f, c in out.items()}
        if self.norm.endswith("l2norm_row"):
            length = F.sqrt(sum((c * c for c in out.values()), F.lit(0.0)))
            out = {f: F.when(length == 0, c).otherwise(c / length) for f, c in out.items()}
        return out

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        return df.withColumns({f + suffix: c for f, c in self.columns().items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Layer:
        data = json.loads(text)
        return Layer(**data | {"features": tuple(data["features"])})


def fit_layer(df: DataFrame, features: Sequence[str], transform: str = "none", norm: str = "zscore_col", cofactor: float = COFACTOR) -> Layer:
    """One aggregate for the scales of logicle, one for the normalisation. Spread is the population SD, or the range; 0 counts as 1."""
    if transform not in TRANSFORMS or norm not in NORMALIZATIONS:
        raise ValueError(f"unknown transform or normalisation: {transform}, {norm}")
    features = tuple(features)
    scale: dict[str, float] = {}
    if transform == "logicle":
        got = df.agg(*[F.percentile(F.col(f).cast("double"), 0.99).alias(f) for f in features]).first()
        scale = {f: max(got[f] if got[f] is not None else 1.0, 1.0) for f in features}
    layer = Layer(features, transform, norm, cofactor, scale)
    if norm in ("none", "l2norm_row"):
        return layer
    shift, spread = {}, {}
    for k in range(0, len(features), 50):  # generated code has a size limit
        part = features[k : k + 50]
        low, wide = (F.min, lambda c: F.max(c) - F.min(c)) if norm == "minmax_col" else (F.avg, F.stddev_pop)
        got = df.agg(*[a for f in part for a in (low(layer.transformed(f)).alias(f"a_{f}"), wide(layer.transformed(f)).alias(f"b_{f}"))]).first()
        for f in part:
            shift[f], spread[f] = (got[f"a_{f}"] if got[f"a_{f}"] is not None else 0.0), got[f"b_{f}"] or 1.0
    return Layer(features, transform, norm, cofactor, scale, shift, spread)


def color_means(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """df without channels but with the row-wise mean of each laser and pulse (a missing value makes it null); others are dropped."""
    import re

    groups: dict[tuple[str, str], list[str]] = {}
    for c in channels:
        if m := re.fullmatch(r"([A-Za-z]+)\d*-([AHW])", c):
            groups.setdefault((m[1], m[2]), []).append(c)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in channels]
    order = sorted(groups, key=lambda g: (g[0], "AHW".index(g[1])))
    return df.select(*kept, *[(sum((F.col(f"`{c}`") for c in groups[g]), F.lit(0.0)) / len(groups[g])).alias(f"{g[0]}-{g[1]}") for g in order])
