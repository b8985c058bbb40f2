"""The preprocessing plan: validate, subset, select features, fit the layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import layers, rows, space

METHODS = ("CorrFilter", "MIM", "CMI", "HighVariance", "PCALoadings")


@dataclass(frozen=True)
class Plan:
    filters: dict[str, Sequence] = field(default_factory=dict)
    per_subject: int | None = None
    subject: str = "subject_ID"
    key: tuple[str, ...] = ("row_id",)
    methods: tuple[str, ...] = ()
    threshold: float = 0.9
    top: int = 10
    label: str | None = None
    transform: str = "none"
    norm: str = "zscore_col"

    def check(self) -> None:
        if self.transform not in layers.TRANSFORMS or self.norm not in layers.NORMALIZATIONS:
            raise ValueError(f"unknown layer {self.transform}, {self.norm}")
        if unknown := set(self.methods) - set(METHODS):
            raise ValueError(f"unknown selection methods {sorted(unknown)}")
        if {"MIM", "CMI"} & set(self.methods) and not self.label:
            raise ValueError("MIM and CMI need a label")


def select_features(df: DataFrame, features: Sequence[str], plan: Plan) -> list[str]:
    """The correlation filter comes first; the other methods score what survives, and a feature must pass all of them."""
    pool = list(features)
    if "CorrFilter" in plan.methods:
        pool = space.correlation_filter(df, pool, plan.threshold)
    kept = set(pool)
    for method in (m for m in METHODS if m in plan.methods and m != "CorrFilter"):
        if method == "HighVariance":
            best = space.top_features(space.variances(df, pool), plan.top)
        elif method == "PCALoadings":
            best = space.top_features(space.loading_scores(df, pool), plan.top)
        else:
            mi = {r["feature"]: r["mi"] for r in space.mutual_information(df, pool, plan.label).collect()}
            scores = {f: mi.get(f, 0.0) for f in pool}
            best = space.top_features(scores, plan.top) if method == "MIM" else space.relevance_minus_redundancy(scores, space.correlations(df, pool), pool)[: plan.top]
        kept &= set(best)
    return [f for f in features if f in kept]


def run(df: DataFrame, features: Sequence[str], plan: Plan) -> tuple[DataFrame, list[str], layers.Layer]:
    """The subset with layer columns (suffix _z), the selected features, the frozen layer over all features."""
    plan.check()
    part = rows.subset(df, plan.filters, strict=False)
    if plan.per_subject:
        part = rows.sample_per_group(part, plan.subject, plan.per_subject, plan.key, replace_if_short=True)
    chosen = select_features(part, features, plan)
    layer = layers.fit_layer(part, features, plan.transform, plan.norm)
    return layer.apply(part, "_z"), chosen, layer
