"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Each source s has a piecewise-linear weight schedule w_s(t) over training time t in [0, 1].
Its integral W_s(1) gives its share of all tokens; shares are cut at `cap` times the source's
size and the excess is dealt again by weight (water filling, in closed form over the sources
sorted by where they fill up). The documents of a source, in the order of a keyed digest and
again for each further epoch, form one stream of tokens. The copy whose middle token lies at
m of that stream is taken if m is below the target T_s, at the time t that solves
W_s(t) / W_s(1) = m / T_s: a quadratic on one segment of the schedule. Sorting by t (a range
exchange) gives the training order.

Scale: no window spans a source. Documents are dealt to `buckets` digest buckets per source;
prefix sums run inside a bucket, and over the (source, bucket) sums, which are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

#: Weights by a source's rank, repeating, and their course over time: (start, end) factors of a linear ramp with integral 1.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def plan_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[tuple[float, float], ...] = RAMPS, cap: float = 3.0
) -> DataFrame:
    """Rows (source_key, source_size, weight, target, w0, w1) from (source_key, source_size), one per source.

    Sources rank by code point, null last; a source's schedule runs linearly from w0 to w1, of
    integral `weight`. The table has a row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source_key.is_null"), F.col("source_key.name"))
    rank = F.row_number().over(by_name) - 1
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).select(
        "*",
        pick(weights, F.col("rank")).alias("weight"),
        pick([a for a, _ in ramps], F.col("rank")).alias("a"),
        pick([b for _, b in ramps], F.col("rank")).alias("b"),
    )
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(by_fill), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)).alias("weight_before"),
    ).withColumn(
        # words per unit of weight if exactly the sources before this one are full
        "level",
        (F.col("total") - F.lit(float(cap)) * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")),
    )
    full = F.col("level") * F.col("weight") >= F.lit(float(cap)) * F.col("source_size")
    # the level that holds is that of the first source that isn't full
    fill = (F.col("source_size") / F.col("weight")).alias("fill")
    first_open = F.min(F.when(~full, F.struct(fill, "rank", "level"))).over(every)
    return level.withColumn("held", first_open["level"]).select(
        "source_key",
        "source_size",
        "weight",
        F.when(full, F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("held") * F.col("weight")).alias("target"),
        (F.col("weight") * F.col("a")).alias("w0"),
        (F.col("weight") * F.col("b")).alias("w1"),
    )


def _time(share: Column, w0: Column, w1: Column) -> Column:
    """t in [0, 1] with (integral of the line from w0 to w1 up to t) = share of the whole integral."""
    whole = (w0 + w1) / 2
    slope = w1 - w0
    root = F.sqrt(w0 * w0 + 2 * slope * share * whole)
    return F.when(slope == 0, share).otherwise(2 * share * whole / (w0 + root))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    ramps: tuple[tuple[float, float], ...] = RAMPS,
    cap: float = 3.0,
    buckets: int = 1024,
    seed: str = "mix",
) -> DataFrame:
    """The columns of docs and size, source_size, target (long, long, double), times: an array with a time for each copy taken.

    docs needs doc_id, text and source; other columns are kept as they are. A document is taken
    whole or not, floor(target / source size) times or once more, so a source's words differ from
    its target by half a document at most.

    Null text counts 0 words; a null source is a source of its own, last in order; null doc_ids
    take part. Documents are ordered by the digest of doc_id, then by doc_id, size and the digest
    of the text; rows equal in these are interchangeable. Empty input gives an empty result, and
    where no source has a word, targets are 0 and nothing is taken. Column names that start with
    "_mix" are reserved.
    """
    if not weights or min(weights) <= 0 or cap < 1:
        raise ValueError("weights must be positive, cap at least 1")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    named = docs.drop("size", "source_size", "target", "times").select(
        "*",
        F.struct(F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("name")).alias("_mix_source"),
        word_count(F.col("text")).alias("size"),
        digest.alias("_mix_digest"),
    )
    sized = named.withColumn("_mix_bucket", F.conv(F.substring("_mix_digest", 1, 8), 16, 10).cast("long") % buckets)
    by_bucket = sized.groupBy(F.col("_mix_source").alias("source_key"), F.col("_mix_bucket").alias("bucket")).agg(
        F.sum("size").alias("words")
    )
    by_source = by_bucket.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        by_bucket.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(plan_targets(by_source, weights, ramps, cap), "source_key")
        .select(
            F.col("source_key").alias("_mix_source"),
            F.col("bucket").alias("_mix_bucket"),
            F.col("start").alias("_mix_start"),
            "source_size",
            "target",
            F.col("w0").alias("_mix_w0"),
            F.col("w1").alias("_mix_w1"),
        )
    )
    inside = (
        Window.partitionBy("_mix_source", "_mix_bucket")
        .orderBy("_mix_digest", "doc_id", "size", *([F.xxhash64("text")] if "text" in docs.columns else []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = sized.withColumn("_mix_at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, ["_mix_source", "_mix_bucket"]
    )
    middle = lambda k: k * F.col("source_size") + F.col("_mix_start") + F.col("_mix_at") + F.col("size") / 2
    times = F.when(
        F.col("source_size") > 0,
        F.transform(
            F.filter(
                F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int")),
                lambda k: middle(k) < F.col("target"),
            ),
            lambda k: _time(middle(k) / F.col("target"), F.col("_mix_w0"), F.col("_mix_w1")),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return laid.withColumn("times", times).drop(
        "_mix_source", "_mix_bucket", "_mix_digest", "_mix_start", "_mix_at", "_mix_w0", "_mix_w1"
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy taken, with its time, range-sorted by time; ties by doc_id."""
    copies = mixed.select("*", F.posexplode("times").alias("epoch", "time")).drop("times")
    return copies.orderBy("time", "doc_id", "epoch")
