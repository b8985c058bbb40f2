"""Near copies by word shingles: exact Jaccard similarity of candidates from MinHash bands.

At a similarity of 0.8 SimHash values of 64 bits differ in 10 bits on average and often in 15; no
table of segments is selective at such a radius. So candidates come from `bands` keys of `rows`
minima each (20 of 6: a pair at 0.8 shares no key with probability 0.002, at 0.9 with 2e-7), and
each candidate pair is verified on the shingles of both texts.

Only links between documents that aren't yet known to be connected are worth a comparison. First
each document is compared with the smallest one it shares a key with, which joins most groups.
Then keys whose documents lie in several components remain: up to `cap` documents are compared
pair by pair, a larger crowd with a pivot. What is then left of crowds, documents that are alike but
mostly not alike enough, gets other keys: of a document's shingles the rarest, so many that two
documents at the threshold must share one (the prefix filter of exact similarity joins). Such
documents are compared in blocks, after `rounds` more pivots, so no link is skipped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, give_back, join_hot, materialize, remove
from .simhash import words_of

#: Shingles whose minima are taken at a time: all keys of a block stay in a core's cache.
_BLOCK = 256


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit values of the word shingles, sorted; fewer than `width` words make one shingle of all of them, none an empty array."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


@functools.cache
def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def band_keys(values: np.ndarray, bands: int, rows: int, seed: int) -> list[int]:
    a, b = _hashes(bands * rows, seed)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    room = np.empty((bands * rows, _BLOCK), dtype=np.uint64)
    for at in range(0, len(values), _BLOCK):
        part = values[None, at : at + _BLOCK]
        h = np.multiply(a, part, out=room[:, : part.shape[1]])
        np.minimum(low, np.add(h, b, out=h).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in low.reshape(bands, rows)]


def _node(docs: DataFrame, text: str) -> Column:
    """A document; in order of doc_id (null last), then digest of the text. A missing doc_id counts as zero of its type, or as the text "0"."""
    kind = docs.schema["doc_id"].dataType
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"), F.xxhash64(F.col(text)).alias("digest"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts reach the threshold."""

    @F.arrow_udf("boolean")
    def alike(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            yield pa.array([jaccard(shingles(x.as_py(), width), shingles(y.as_py(), width)) >= threshold for x, y in zip(a, b, strict=True)], type=pa.bool_())
        give_back()

    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    known = materialize(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "similar-texts")
    left, right = known.toDF("u", "left"), known.toDF("v", "right")
    linked = materialize(pairs.join(left, "u").join(right, "v").where(alike("left", "right")).select("u", "v"), "similar-links")
    remove(known)
    return linked


def _rarest(nodes: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Rows (key, node, m, near): of each document the rarest of its shingles, so many that two documents at the threshold share one, without those that no other has.

    m is the number of its shingles. The shared one is `near`, among fewer of the rarest, in the
    document with fewer shingles, as two of these lengths must have that much in common.
    """

    @F.arrow_udf("array<long>")
    def values(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in parts:
            yield pa.array([shingles(t.as_py(), width).view(np.int64) for t in some], type=pa.list_(pa.int64()))
        give_back()

    own = materialize(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", values("text").alias("s")), "shingles")
    long = own.select("node", F.explode("s").alias("key"))
    total = long.count()
    often = materialize(long.groupBy("key").agg(F.count("*").alias("n")).withColumn("hot", F.col("n") * HOT_SHARE >= total), "often")
    ranked = join_hot(long, often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    # a rounding error may only make these longer
    first = lambda share: (F.size("s") - F.ceil(F.lit(share - 1e-9) * F.size("s")) + 1).cast("int")
    known = F.transform(F.slice("s", F.lit(1), first(threshold)), lambda x, i: F.struct(x["key"].alias("key"), x["n"].alias("n"), (i < first(2 * threshold / (1 + threshold))).alias("near")))
    return ranked.select("node", F.size("s").alias("m"), F.explode(F.filter(known, lambda x: x["n"] > 1)).alias("x")).select("x.key", "node", "m", "x.near")


#: Documents of a block, two of which are compared in one task.
_SIDE = 256


def _in_blocks(rows: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (u, v) between documents of different roots that keys connect; rows has (key, node, root).

    Documents that share keys, directly or not, are one crowd, dealt into blocks; each two blocks
    are compared in one task, so a text travels once for each block and only a forest comes back.
    """
    nodes = rows.select("key", "node", "root")
    star = nodes.join(nodes.groupBy("key").agg(F.min("node").alias("low")), "key").select(F.col("node").alias("u"), F.col("low").alias("v"))
    tag = lambda c: F.concat_ws("|", F.col(f"{c}.no_id").cast("string"), F.col(f"{c}.id").cast("string"), F.col(f"{c}.digest").cast("string"))
    crowd = components(star).select("node", tag("root").alias("crowd"))
    known = materialize(
        nodes.select("node", "root").distinct().join(crowd, "node").join(texts.join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node").select("node", tag("node").alias("tag"), tag("root").alias("root"), "crowd", "text"), "crowd"
    )
    sizes = known.groupBy("crowd").agg(F.ceil(F.count("*") / _SIDE).cast("int").alias("blocks"))
    dealt = known.drop("node").join(F.broadcast(sizes) if sizes.limit(1001).count() <= 1000 else sizes, "crowd").withColumn("b", F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int"))
    cell = lambda c: F.struct(F.least("b", c).alias("x"), F.greatest("b", c).alias("y"), (c == F.col("b")).alias("own"), F.col("b").alias("b"))
    cells = dealt.select("crowd", "tag", "root", "text", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)).alias("c")).select("crowd", "tag", "root", "text", "c.*")
    rows_of_cells = cells.count()
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, rows_of_cells // _SIDE))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [frozenset(shingles(t, width).tolist()) for t in pdf["text"]]
        tags, own, block = pdf["tag"].tolist(), pdf["own"].tolist(), pdf["b"].tolist()
        of_root = {r: k for k, r in enumerate(dict.fromkeys(pdf["root"]))}
        top = list(range(len(of_root)))

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        place = [of_root[r] for r in pdf["root"]]
        order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        out = []
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if len(sets[a]) < (threshold - 1e-9) * len(sets[b]):
                    break  # the others have more shingles still
                if (own[a] and own[b]) != (block[a] == block[b]) or find(place[a]) == find(place[b]):
                    continue
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    top[find(place[a])] = find(place[b])
                    out.append((tags[a], tags[b]))
        return pd.DataFrame(out, columns=["u", "v"], dtype=object)

    met = materialize(cells.repartition(parts, "crowd", "x", "y").groupBy("crowd", "x", "y").applyInPandas(compare, "u string, v string"), "met")
    name = known.select("tag", "node")
    links = materialize(met.join(name.toDF("u", "a"), "u").join(name.toDF("v", "b"), "v").select(*_ordered("a", "b")), "similar-links")
    for done in (known, met):
        remove(done)
    return links


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def similar_to_smaller(
    docs: DataFrame, text: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 6, cap: int = 16, rounds: int = 0, seed: int = 11
) -> DataFrame:
    """Rows (doc_id, digest), digest the xxhash64 of the text: documents that links of similarity `threshold` join to a smaller document.

    Equal texts are one document with the smallest doc_id (null last); the others of them aren't
    listed. doc_id keeps its type, a number or a string. Texts without words are similar to nothing. An empty table gives an empty result;
    extra columns are ignored.
    """

    @F.arrow_udf("array<long>")
    def keys(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = (shingles(t.as_py(), width) for t in texts)
            yield pa.array([band_keys(v, bands, rows, seed) if len(v) else None for v in found], type=pa.list_(pa.int64()))
        give_back()

    texts = docs.select(_node(docs, text).alias("node"), F.col(text).cast("string").alias("text"))
    signed = materialize(texts.select("node", keys("text").alias("keys")).where("keys is not null"), "bands")
    distinct = signed.groupBy("node.digest").agg(F.min_by("keys", "node").alias("keys"), F.min("node").alias("node"))
    placed = materialize(
        distinct.select("node", F.posexplode("keys").alias("band", "at")).select("node", F.xxhash64("band", "at").alias("key")), "buckets"
    )
    shared = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    met = materialize(placed.join(shared, "key").select("key", "node", "pivot"), "shared")
    tested = materialize(met.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pivot")).select(*_ordered("node", "pivot")), "similar-pairs")
    links = _verified(tested, texts, width, threshold)
    found = materialize(components(links), "components")
    keyed = met.select("key", "node", F.lit(0).alias("m"), F.lit(True).alias("near"))
    for last in (False, True):
        for turn in range((rounds if last else 1) + 1):
            of_root = keyed.join(found, "node", "left").select("key", "node", "m", "near", F.coalesce("root", "node").alias("root"))
            open_keys = (
                of_root.groupBy("key")
                .agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
                .where("a <> b")
                .withColumn("all", F.col("n") <= cap)
                .select("key", "pivot", "all")
            )
            rows_left = materialize(of_root.join(open_keys, "key"), "crowds")
            whole, part = rows_left.where("all"), rows_left.where("not all")
            if not last and turn:
                break
            if last and turn == rounds:
                links = links.unionByName(_in_blocks(rows_left, texts, width, threshold))
                found = materialize(components(links), "components")
                break
            second = [F.col(c).alias(f"other_{c}") for c in ("node", "root", "m", "near")]
            pivots, others = part.where("node = pivot").select("key", *second), whole.select("key", *second)
            mine = F.struct("m", "node") < F.struct("other_m", "other_node")
            may = (F.when(mine, F.col("near")).otherwise(F.col("other_near"))) & (F.least("m", "other_m") >= (threshold - 1e-9) * F.greatest("m", "other_m"))
            pairs = (
                whole.join(others, "key")
                .where("node > other_node")
                .unionByName(part.join(pivots, "key"))
                .where(may & (F.col("root") != F.col("other_root")))
                .select(*_ordered("node", "other_node"))
                .distinct()
                .join(tested, ["u", "v"], "left_anti")
            )
            pairs = materialize(pairs, "similar-pairs")
            if not pairs.isEmpty():
                links = links.unionByName(_verified(pairs, texts, width, threshold))
                found = materialize(components(links), "components")
                tested = tested.unionByName(pairs)
            # small keys are done, and so is a pivot
            keyed = part.where("node <> pivot").select("key", "node", "m", "near")
            if keyed.isEmpty():
                break
        if keyed.isEmpty():
            break
        if not last:
            keyed = materialize(_rarest(rows_left.select("node").distinct(), texts, width, threshold), "rarest")
    for done in (signed, placed, met):
        remove(done)
    out = found.where("node <> root").select("node")
    return out.select(F.when(~F.col("node.no_id"), F.col("node.id")).alias("doc_id"), F.col("node.digest").alias("digest"))
