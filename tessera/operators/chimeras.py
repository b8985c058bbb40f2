"""Synthetic mixtures of two subjects, and how stable dispersion is when fewer rows are drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dataset import written
from .heterogeneity import dispersion
from .layers import fit_layer

RATIOS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SIZES = (20, 30, 50, 80, 100, 150)


def _order(key: Sequence[str], seed: Column) -> Column:
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") for c in key]))


def chimeras(df: DataFrame, subject: str, first: str, second: str, key: Sequence[str], ratios: Sequence[float] = (0.5,), repeats: int = 1, n: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of all mixtures with their ratio and repeat: floor(n x ratio) rows of the first subject, the rest of the second, without replacement.

    n is the size of the smaller subject unless given; more than a subject has is an error. The
    subject column becomes chimera_{first}x{second}_r{ratio}_{repeat}; all mixtures are one plan.
    """
    own = F.col(subject).cast("string")
    rows = df.where(own.isin(first, second))
    sizes = {r[0]: r[1] for r in rows.groupBy(own).count().collect()}  # two rows
    if set(sizes) != {first, second}:
        raise ValueError("a subject has no rows")
    n = n or min(sizes.values())
    if any(int(n * r) > sizes[first] or n - int(n * r) > sizes[second] for r in ratios):
        raise ValueError("a subject has too few rows")
    plan = F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.lit(int(n * r)).alias("a"), F.lit(n - int(n * r)).alias("b")) for r in ratios])
    drawn = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rank = F.row_number().over(Window.partitionBy(subject, "repeat").orderBy(_order(key, F.lit(seed) + F.col("repeat")), *key))  # one order serves all ratios
    of = F.filter(plan, lambda p: F.col("_rank") <= F.when(own == first, p["a"]).otherwise(p["b"]))
    taken = drawn.withColumn("_rank", rank).withColumn("_p", F.explode(of)).withColumn("ratio", F.col("_p.ratio")).drop("_rank", "_p")
    return taken.withColumn(subject, F.concat(F.lit(f"chimera_{first}x{second}_r"), F.format_string("%.2f", "ratio"), F.lit("_"), F.col("repeat").cast("string")))


def validate(df: DataFrame, subject: str, first: str, second: str, features: Sequence[str], key: Sequence[str], ratios: Sequence[float] = RATIOS, repeats: int = 3, slack: float = 0.01, seed: int = 42) -> DataFrame:
    """Rows (ratio, n, mean_d, sd_d, rising): dispersion of the mixtures; the pure subjects have ratios 1 and 0.

    rising tells whether mean_d is no more than `slack` below that of the ratio before, for ratios up to a half.
    """
    df = df.select(*dict.fromkeys((subject, *features, *key)))
    made = chimeras(df, subject, first, second, key, ratios, repeats, seed=seed)
    own = F.col(subject).cast("string")
    pure = df.where(own.isin(first, second)).withColumns({"ratio": F.when(own == first, 1.0).otherwise(0.0), "repeat": F.lit(0), subject: own})
    both = written(made.unionByName(pure).select(subject, "ratio", *features), "mixtures")
    of = both.groupBy(subject).agg(F.first("ratio").alias("ratio"))
    per = dispersion(both, subject, features, large=True).join(of, subject).groupBy("ratio").agg(F.count(F.lit(1)).alias("n"), F.avg("mhi_d").alias("mean_d"), F.stddev_samp("mhi_d").alias("sd_d"))
    before = F.lag("mean_d").over(Window.orderBy("ratio"))  # a row per ratio
    checked = F.col("ratio").between(min(ratios), 0.5) & before.isNotNull() & (F.col("ratio") > min(ratios))
    return per.withColumn("rising", F.when(checked, F.col("mean_d") >= before - slack))


def validate_all(df: DataFrame, subject: str, group: str, features: Sequence[str], key: Sequence[str], labels: tuple[str, str], **options) -> DataFrame:
    """validate() for each pair of a subject of the first label with one of the second; a pair that fails is left out."""
    of = df.where(F.col(group).isin(*labels)).select(F.col(group).alias("g"), F.col(subject).cast("string").alias("s")).distinct().collect()
    out = None
    for a in sorted(r["s"] for r in of if r["g"] == labels[0]):
        for b in sorted(r["s"] for r in of if r["g"] == labels[1]):
            try:
                one = validate(df, subject, a, b, features, key, **options).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "*")
            except ValueError:
                continue
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no pair can be mixed")
    return out


def sensitivity(df: DataFrame, subject: str, features: Sequence[str], key: Sequence[str], sizes: Sequence[int] = SIZES, repeats: int = 10, limit: float = 5.0, seed: int = 42) -> DataFrame:
    """Rows (subject, size, mean_d, cv, stable): median distance to the centroid in draws of `size` rows; cv is 100 x sample SD / mean over the repeats.

    Only subjects with more than max(sizes) + 1 rows. One draw order per repeat serves all sizes,
    so rows are copied `repeats` times, and once more per size that they belong to.
    """
    counts = df.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(sizes) + 1).drop("_n")
    z = fit_layer(df, features).apply(df, "_z")
    cols = [f"{f}_z" for f in features]
    kept = z.join(counts, subject).select(subject, *dict.fromkeys([*key, *cols]), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    rank = F.row_number().over(Window.partitionBy(subject, "repeat").orderBy(_order(key, F.lit(seed) + F.col("repeat")), *key))
    drawn = kept.withColumn("_rank", rank).where(F.col("_rank") <= max(sizes))
    sized = drawn.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col("_rank"))))
    w = Window.partitionBy(subject, "repeat", "size")
    gaps = [F.col(c) - F.avg(c).over(w) for c in cols]
    far = sized.withColumn("d", F.sqrt(sum((g * g for g in gaps), F.lit(0.0))))
    per = far.groupBy(subject, "repeat", "size").agg(F.median("d").alias("d"))
    out = per.groupBy(subject, "size").agg(F.avg("d").alias("mean_d"), (100 * F.stddev_samp("d") / F.avg("d")).alias("cv"))
    return out.withColumn("stable", F.col("cv") < limit)
