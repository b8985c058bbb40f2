"""What bags of other sizes would show, and feature selection for models of bags, within folds or before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import written
from . import density_trees, learners, space
from .density import clustering_quality
from .layers import fit_layer
from .models import BAG_STATISTICS, Clusters, fold_of
from .models import bags as drawn_bags
from .neighbour_information import neighbour_information
from .rows import first_per_group, sample_order

METHODS = ("CorrFilter", "MIM", "CMI", "HighVariance", "PCALoadings")


def nested_bags(df: DataFrame, subject: str, features: Sequence[str], sizes: Sequence[int], n_bags: int, key: Sequence[str], statistics: Sequence[str] = ("mean", "std"), seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Rows (subject, bag, size, n_rows, {feature}__{statistic}): models.bags() of every size from one ordering.

    A bag's rows in the order of its digest are ranked once; the bag of each size is a prefix, so
    smaller bags lie within larger ones, and a row is repeated for the sizes it belongs to only
    after all others are gone.
    """
    sizes = sorted(set(sizes))
    drawn = df.where(F.col(subject).isNotNull()).select(*dict.fromkeys((subject, *key, *ties, *features))).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("bag").cast("string"), *[F.col(c).cast("string") for c in key]))
    ranked = first_per_group(drawn, [subject, "bag"], order, sizes[-1], [*key, *ties])
    of_size = ranked.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col("_rank"))))
    aggs = [BAG_STATISTICS[s](f).alias(f"{f}__{s}") for f in features for s in statistics]
    return of_size.groupBy(subject, "bag", "size").agg(F.count("*").alias("n_rows"), *aggs)


def compare_bag_sizes(
    df: DataFrame, subject: str, features: Sequence[str], sizes: Sequence[int], n_bags: int, key: Sequence[str], condition: str, statistics: Sequence[str] = ("mean", "std"),
    min_cluster_size: int = 5, sample: int = 10_000, seed: int = 42, ties: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """How bags of each size fall into density clusters: a row per size, and the bags (subject, bag, size, cluster, condition).

    The former has n_bags, clusters, noise (share), silhouette (of at most `sample` bags) and purity:
    the share of clustered bags whose condition is the most frequent one of their cluster. Features
    are standardised within a size. `condition` is the subject's first in order.
    """
    made = written(nested_bags(df, subject, features, sizes, n_bags, key, statistics, seed, ties), "bags")
    names = [f"{f}__{s}" for f in features for s in statistics]
    of_subject = written(df.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.min(F.col(condition).cast("string")).alias("condition")), "conditions")
    bags, rows = None, []
    for size in sorted(set(sizes)):
        own = made.where(F.col("size") == size).dropna(subset=names)
        z = fit_layer(own, names).apply(own)
        named = written(density_trees.hdbscan(z, [subject, "bag"], names, min_cluster_size).join(of_subject, subject, "left"), "named")
        x = z.join(named, [subject, "bag"]).orderBy(sample_order([subject, "bag"], seed), subject, "bag").limit(sample).select("cluster", *names).toPandas()
        by = named.groupBy("cluster", "condition").count().groupBy("cluster").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
        got = by.agg(F.sum("n").alias("n"), F.count_if(F.col("cluster") >= 0).alias("k"), F.sum(F.when(F.col("cluster") < 0, F.col("n"))).alias("noise"), (F.sum(F.when(F.col("cluster") >= 0, F.col("top"))) / F.sum(F.when(F.col("cluster") >= 0, F.col("n")))).alias("purity")).first()
        score = clustering_quality(x[names].to_numpy(dtype=float), x["cluster"].to_numpy())["silhouette"]
        rows.append((size, got["n"] or 0, got["k"] or 0, (got["noise"] or 0) / got["n"] if got["n"] else None, None if score != score else float(score), got["purity"]))
        part = named.select(subject, "bag", F.lit(size).alias("size"), "cluster", "condition")
        bags = part if bags is None else bags.unionByName(part)
    table = df.sparkSession.createDataFrame(rows, "size int, n_bags long, clusters long, noise double, silhouette double, purity double")
    return table, bags


def cluster_shares(df: DataFrame, model: Clusters, subject: str, n_bags: int, size: int, key: Sequence[str], seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Rows (subject, bag, n_rows, cluster_{k}__share): the share of each cluster among a bag's rows, which are those of models.bags().

    Rows that the model can't place count towards none, so a bag's shares may sum to less than 1.
    """
    names = [f"cluster_{k + 1}" for k in range(len(model.centroids))]
    placed = model.assign(df, "_cluster")
    marked = placed.withColumns({n: F.coalesce((F.col("_cluster") == n.capitalize()).cast("double"), F.lit(0.0)) for n in names})
    made = drawn_bags(marked, subject, names, n_bags, size, key, ("mean",), seed, ties)
    return made.withColumnsRenamed({f"{n}__mean": f"{n}__share" for n in names})


def bag_overlap(df: DataFrame, subject: str, size: int, most: float = 0.2) -> DataFrame:
    """Rows (subject, n_rows, overlap, flagged): the share of its rows that a bag of `size` is expected to have in common with another of the subject, and whether it is above `most`."""
    n = df.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.count(F.lit(1)).alias("n_rows"))
    share = F.least(F.lit(1.0), F.lit(float(size)) / F.col("n_rows"))
    return n.select(subject, "n_rows", share.alias("overlap"), (share > most).alias("flagged"))


def of_statistics(names: Sequence[str], keep: Sequence[str]) -> list[str]:
    """Bag features of the statistics kept, in order."""
    return [n for n in names if n.rpartition("__")[2] in keep]


def base_names(names: Sequence[str]) -> list[str]:
    """The features that bag features are of, each once, in order."""
    return list(dict.fromkeys(n.rpartition("__")[0] if n.rpartition("__")[2] in BAG_STATISTICS else n for n in names))


def select_features(df: DataFrame, features: Sequence[str], label: str, methods: Sequence[str], top_k: int = 10, threshold: float = 0.9) -> list[str]:
    """What is left of the features when each method works on what the ones before left.

    CorrFilter drops features that correlate above the threshold with an earlier one; the others
    keep the top_k: by neighbour information with the label (MIM), the same less redundancy (CMI),
    variance, or loadings. Features keep their order.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}; there are {METHODS}")
    left = list(features)
    for method in methods:
        if not left:
            break
        if method == "CorrFilter":
            left = space.correlation_filter(df, left, threshold)
            continue
        if method in ("MIM", "CMI"):
            scores = dict.fromkeys(left, 0.0) | {r["feature"]: r["mi"] for r in neighbour_information(df, left, label).collect()}
        else:
            scores = space.variances(df, left) if method == "HighVariance" else space.loading_scores(df, left)
        if method == "CMI":
            kept = set(space.relevance_minus_redundancy(scores, space.correlations(df, left), left)[:top_k])
        else:
            kept = set(space.top_features(scores, top_k))
        left = [f for f in left if f in kept]
    return left


def held_out_selected(
    df: DataFrame, features: Sequence[str], label: str, group: str, methods: Sequence[str], top_k: int = 10, threshold: float = 0.9, before: bool = False, name: str = "RandomForest", folds: int = 5, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions as learners.held_out_predictions(), with features selected on each fold's training rows; and rows (fold, feature).

    With `before` they are selected once, on all rows, as is often done: held-out scores are then
    too good, for the selection has seen the labels of the rows held out.
    """
    rows = df.dropna(subset=[label, group, *features]).withColumn("_label", F.col(label).cast("string")).withColumn("fold", fold_of([group], folds, seed))
    indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    if len(indexer.labels) < 2:
        raise ValueError("a classifier needs two labels or more")
    rows = indexer.transform(rows)
    once = select_features(rows, features, "_label", methods, top_k, threshold) if before else None
    out, chosen = None, []
    for f in range(folds):
        train = F.col("fold") != f
        if rows.where(~train).isEmpty() or rows.where(train).select("_y").distinct().count() < 2:
            continue
        own = once if once is not None else select_features(rows.where(train), features, "_label", methods, top_k, threshold)
        if not own:
            continue
        z = learners.scaled(rows, train, own)
        predict, _ = learners.fit(z.where(train), own, name, len(indexer.labels), seed)
        got = predict(z.where(~train)).drop("_label")
        chosen += [(f, c) for c in own]
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no fold can be evaluated")
    return out, df.sparkSession.createDataFrame(chosen, "fold int, feature string")
