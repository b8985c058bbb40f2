"""Cluster models that know their space: fitted on a reference table, saved, and replayed on others.

A model holds the frozen space, centroids or mixture components numbered by size, the table its
number of clusters was chosen from, profiles, statistics of the training features, a limit beyond
which rows are atypical, and where it comes from.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixtures, models
from .aggregates import nested_weights
from .ordered import quantile
from .spaces import Space

ALGORITHMS = ("kmeans", "gmm")
VERSION = 1
#: Largest difference at which stored coordinates count as the space's own.
EXACT = 1e-3


@dataclass(frozen=True)
class ClusterModel:
    name: str
    algorithm: str
    space: Space
    clusters: models.Clusters | mixtures.Mixture
    limit: float
    selection: tuple[dict, ...] = ()
    profiles: tuple[dict, ...] = ()
    statistics: tuple[dict, ...] = ()
    provenance: Mapping[str, Any] = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.clusters.centroids) if isinstance(self.clusters, models.Clusters) else len(self.clusters.weights)

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(f"Cluster_{j + 1}" for j in range(self.k))

    def assign(self, df: DataFrame, name: str = "cluster", stored: bool = False) -> DataFrame:
        """df with the cluster (null where a feature is missing), `{name}_score` (distance to the centroid, or log density) and `{name}_atypical`.

        Coordinates are projected anew from the raw features, or with `stored` taken as they are.
        """
        at = df if stored else self.space.project(df)
        known = sum((F.col(c).isNull().cast("int") for c in self.space.names), F.lit(0)) == 0
        if isinstance(self.clusters, models.Clusters):
            got = self.clusters.assign(at, name).withColumnRenamed(f"{name}_distance", f"{name}_score")
            return got.withColumn(f"{name}_atypical", F.col(f"{name}_score") > self.limit)
        place, density = self.clusters.columns()
        got = at.withColumns({name: F.when(known, F.concat(F.lit("Cluster_"), (place + 1).cast("string"))), f"{name}_score": F.when(known, density)})
        return got.withColumn(f"{name}_atypical", F.col(f"{name}_score") < self.limit)

    def place(self, rows: DataFrame, said: Mapping[str, Any] | None = None, name: str = "cluster") -> tuple[DataFrame, dict]:
        """assign() for a table whose metadata may say that it holds this space's coordinates; and what was found.

        Where fingerprints are equal and the stored coordinates differ by less than EXACT from those
        projected anew (all rows are compared), they are used; otherwise rows are projected.
        """
        claimed = self.space.matches(dict(said or {})) and all(c in rows.columns for c in self.space.names)
        gap = self.space.gap(rows) if claimed else math.nan
        exact = claimed and gap < EXACT
        return self.assign(rows, name, stored=exact), {"fingerprints_equal": claimed, "largest_gap": gap, "used": "stored" if exact else "projected"}

    def describe(self) -> dict[str, Any]:
        """What a reader wants to know of the model, flat."""
        return {
            "name": self.name, "algorithm": self.algorithm, "space": self.space.kind, "dimensions": len(self.space.names), "fingerprint": self.space.fingerprint,
            "n_clusters": self.k, "features": list(self.space.features), "atypical_limit": self.limit, **self.provenance,
        }

    def to_json(self) -> str:
        own = json.loads(self.clusters.to_json()) if isinstance(self.clusters, models.Clusters) else mixtures.as_lists(self.clusters)
        data = {"version": VERSION, "space": json.loads(self.space.to_json()), "clusters": own}
        return json.dumps(data | {c: getattr(self, c) for c in ("name", "algorithm", "limit", "selection", "profiles", "statistics", "provenance")})

    @staticmethod
    def from_json(text: str) -> ClusterModel:
        """Raises ValueError for another version, or a space whose parameters were changed."""
        data = json.loads(text)
        if data["version"] != VERSION:
            raise ValueError(f"a model of version {data['version']}; this is {VERSION}")
        own = models.Clusters.from_json(json.dumps(data["clusters"])) if data["algorithm"] == "kmeans" else mixtures.from_lists(data["clusters"])
        rest = {c: tuple(data[c]) for c in ("selection", "profiles", "statistics")}
        return ClusterModel(data["name"], data["algorithm"], Space.from_json(json.dumps(data["space"])), own, data["limit"], **rest, provenance=data["provenance"])


def provenance(df: DataFrame, space: Space, subject: str | None = None, counted: Sequence[str] = (), **more: Any) -> dict[str, Any]:
    """Where a model comes from: when, rows, subjects, rows by each value of `counted`, rows the space was fitted on, and what else is said."""
    got = df.agg(F.count("*").alias("n"), *([F.count_distinct(subject).alias("s")] if subject else [])).first()
    by = {c: {str(r[c]): r["count"] for r in df.groupBy(c).count().orderBy(c).collect()} for c in counted}  # a row per value
    return {
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "rows": got["n"], "subject_column": subject or "", "subjects": got["s"] if subject else 0,
        "counts": by, "space_rows": space.rows_fitted, "space_on_subset": space.rows_fitted != got["n"], **more,
    }


def fit(
    df: DataFrame,
    name: str,
    space: Space,
    key: Sequence[str],
    algorithm: str = "kmeans",
    n_clusters: int | None = None,
    max_clusters: int = 8,
    weight_by: Sequence[str] | None = None,
    subject: str | None = None,
    counted: Sequence[str] = (),
    sample: int = 10_000,
    seed: int = 42,
) -> ClusterModel:
    """A model of the table in the space; without n_clusters, 2 to max_clusters are tried.

    The number is chosen by the silhouette (k-means) or the lowest BIC (mixtures, over all rows).
    With weight_by each value of these columns, nested, counts alike (k-means only). Atypical is
    what lies beyond the 99th percentile of the training rows' distances, or below the first of
    their log densities. Needs more rows than clusters.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    if weight_by and algorithm != "kmeans":
        raise ValueError("only k-means takes weights")
    known = df.dropna(subset=list(space.features))
    n = known.count()
    candidates = [k for k in ([n_clusters] if n_clusters is not None else range(2, max_clusters + 1)) if 1 <= k < n]
    if not candidates:
        raise ValueError(f"{n} rows are too few")
    at = space.project(known)
    if weight_by:
        at = nested_weights(at, list(weight_by), "_w").withColumn("_w", F.col("_w") * n)
    own = [c for c in dict.fromkeys((*key, *space.names, *(["_w"] if weight_by else [])))]
    points = at.select(*own)
    scan, fitted = models.scan_and_fit(points, space.names, candidates, key, sample, algorithm, seed, "_w" if weight_by else None)
    chosen = n_clusters if n_clusters is not None else models.choose_clusters(scan, algorithm)
    selection = tuple(r | {"chosen": r["n_clusters"] == chosen} for r in scan)
    model = ClusterModel(name, algorithm, space, fitted[chosen], math.nan, selection)
    assigned = model.assign(known)
    limit = quantile(assigned, "cluster_score", 0.99 if algorithm == "kmeans" else 0.01)
    raw = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in space.features]).orderBy("cluster").collect()
    profiles = tuple(r.asDict() | {"share": r["n"] / n} for r in raw)  # a row per cluster
    statistics = tuple(r.asDict() for r in models.feature_statistics(space.layer.apply(known), space.features).collect())
    said = provenance(known, space, subject, counted, weight_by=list(weight_by or ()), seed=seed)
    return replace(model, limit=float(limit), profiles=profiles, statistics=statistics, provenance=said)
