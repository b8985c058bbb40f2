"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints at distance 2 or less agree in the
first segment, or agree in the second, or differ by one bit in each. So a fingerprint is fetched
from a table by its first segment, by its second, and, for the last case, by the Hamming ball of
radius 1 around the first segment; of such a ball only neighbours with one more bit set are
enumerated, as the other side of a link enumerates the rest. Matches are verified on all 64 bits.

Documents with one fingerprint count once: links, and components over them, are between distinct
fingerprints. A segment that very many fingerprints share (`hot` or more) would make a quadratic
number of matches, so its rows go another, exact way: the ball of the other segment is enumerated
as well and whole fingerprints are fetched, a bounded number for each, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, give_back, materialize

#: Shingles hashed at a time; bounds the memory that one very long text takes.
_BLOCK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """The words in UTF-8, A-Z lower-cased; bytes.lower and bytes.split know ASCII letters, and blanks \\x20 and \\x09 to \\x0D, alone."""
    return text.encode().lower().split() if text else []


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half the XXH64 values (seed 42) of the word shingles, repeats counted.

    Fewer than `width` words make one shingle of all of them; none (null, empty, blank) gives 0.
    """
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        part = words[at : min(at + _BLOCK, n) + width - 1]
        if len(part) <= width:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        h = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """docs with a long column `name`: the fingerprint of the whole text."""

    @F.arrow_udf("long")
    def simhash(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([fingerprint(t.as_py(), width) for t in texts], type=pa.int64())
        give_back()

    return docs.withColumn(name, simhash(F.col(text).cast("string")))


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _added_bits(x: Column, bits: int = 32) -> Column:
    """The neighbours of x with one more bit set."""
    masks = F.array(*[F.lit(1 << k).cast("long") for k in range(bits)])
    return F.transform(F.filter(masks, lambda m: x.bitwiseAND(m) == 0), lambda m: x.bitwiseOR(m))


def _flips(x: Column, most: int, bits: int = 32) -> Column:
    """x and all values at distance `most` (1 or 2) or less from it."""
    flips = [0] + [1 << k for k in range(bits)]
    if most == 2:
        flips += [(1 << j) | (1 << k) for k in range(bits) for j in range(k)]
    return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda m: x.bitwiseXOR(m))


def links(prints: DataFrame, hot: int = 2048) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints at distance 1 or 2; prints has one long column fp without repeats or nulls."""
    fp = F.col("fp")
    both = prints.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("seg"), _high(fp).alias("val")), F.struct(F.lit(1).alias("seg"), _low(fp).alias("val"))
            )
        ).alias("s"),
    ).select("fp", "s.seg", "s.val")
    crowded = materialize(both.groupBy("seg", "val").count().where(F.col("count") >= hot).select("seg", "val"), "crowded")
    any_crowded = not crowded.isEmpty()
    quiet = both.join(crowded, ["seg", "val"], "left_anti") if any_crowded else both
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2
    pair = [F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")]

    # one segment equal
    table = quiet.withColumnRenamed("fp", "other")
    equal = quiet.join(table, (quiet.seg == table.seg) & (quiet.val == table.val) & (F.col("fp") < F.col("other")) & near)
    # one bit in each
    probes = prints.select("fp", F.explode(_added_bits(_high(fp))).alias("val"))
    firsts = quiet.where("seg = 0").select(F.col("fp").alias("other"), F.col("val").alias("at"))
    each = probes.join(firsts, (F.col("val") == F.col("at")) & near)
    found = equal.select(*pair).unionByName(each.select(*pair))

    if any_crowded:
        # whole fingerprints around those whose segment, or whose neighbour's segment, is crowded
        hot_high, hot_low = (crowded.where(F.col("seg") == k).select("val") for k in (0, 1))
        rows = both.join(crowded, ["seg", "val"], "left_semi")
        same = rows.select(
            "fp",
            F.explode(
                F.when(
                    F.col("seg") == 0,
                    F.transform(_flips(_low(fp), 2), lambda x: F.shiftleft(_high(fp), 32).bitwiseOR(x)),
                ).otherwise(F.transform(_flips(_high(fp), 2), lambda x: F.shiftleft(x, 32).bitwiseOR(_low(fp))))
            ).alias("other"),
        )
        across = (
            probes.join(hot_high, "val", "left_semi")
            .select("fp", "val", F.explode(_flips(_low(fp), 1)).alias("low"))
            .select("fp", F.shiftleft("val", 32).bitwiseOR(F.col("low")).alias("other"))
        )
        whole = same.unionByName(across).where("fp <> other").join(prints.withColumnRenamed("fp", "other"), "other", "left_semi")
        found = found.unionByName(whole.select(*pair))
    return found.distinct()


def _classes(prints: DataFrame, hot: int) -> DataFrame:
    """Rows (fp, root), one for each distinct fingerprint: root is the smallest that links reach."""
    distinct = materialize(prints.select("fp").distinct(), "distinct")
    found = components(links(distinct, hot))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, hot: int = 2048) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs.

    Texts whose fingerprints differ in 2 bits or fewer are linked; component_id is the smallest
    doc_id that links reach. Null and empty texts have fingerprint 0, linked like any other. Null
    doc_ids take part in links; component_id is null only where a component has no doc_id at all.
    Repeated rows stay repeated. Extra columns are dropped; an empty table gives an empty result.
    """
    prints = materialize(with_fingerprint(docs.select("doc_id", F.col(text).alias("_text")), "_text", width).drop("_text"), "prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = _classes(prints, hot).join(first, "fp")
    lowest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = classes.join(lowest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, hot: int = 2048, gone: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the one with the smallest doc_id, all columns kept.

    Where several rows of a group share that doc_id, the smallest digest of the text decides, then
    the other columns in order, so exactly one row of each group stays. Null doc_ids come last.
    Rows (doc_id, digest) of `gone`, found by another rule with the same order, don't stay either.
    """
    named = docs.select("doc_id", F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("digest"))
    prints = materialize(with_fingerprint(named, "_text", width).drop("_text"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    best = _classes(prints, hot).join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = best.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.digest").alias("_kept_digest"))
    if gone is not None:
        kept = kept.join(gone, F.col("_kept_id").eqNullSafe(F.col("doc_id")) & (F.col("_kept_digest") == F.col("digest")), "left_anti")
    kept = materialize(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(F.col(text)) == F.col("_kept_digest"))
    rows = docs.join(kept, same, "left_semi")
    twice = prints.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("digest") == F.col("_kept_digest")), "left_semi")
    if twice.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return rows
    sortable = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    again = Window.partitionBy("doc_id", F.xxhash64(F.col(text))).orderBy(*sortable)
    return rows.withColumn("_again", F.row_number().over(again)).where("_again = 1").drop("_again")
