"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the sign bits of random projections, concatenated; all vectors are
range-sorted by (pass, key, id), and each is compared with its `window` next neighbours in that
order. The order splits anywhere, also among equal keys, so a large group of copies spreads over
all tasks; the last `window` rows of each part are compared with the first of the next, so results
don't hang on the number of parts. Projections are of vectors less their mean, so a cloud away from
the origin doesn't share its signs; pairs are always verified by cosine of the vectors themselves.

Two vectors at the threshold agree in a bit with probability 1 - angle/pi, so those that meet grow
rarer as a pass must tell more vectors apart: passes are added as the logarithm of the table's size
(`passes_for`), and further ones, wherever vectors are denser than that, until the recall that is
estimated from how often sampled pairs were met is reached. Of a task's pairs only a spanning forest
and the sample leave it. Links inside components are then counted exactly: a component is dealt into
blocks of `block` vectors, each two blocks are multiplied in a task of their own, and only counts by
vector leave it. Equal vectors are one row with a multiplicity from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, join_hot, materialize

_BITS = 62


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, dtype=np.float64) for r in rows])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vector):
    """Neither null nor zero, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability `recall`, were the vectors spread evenly.

    A pair meets in a pass if its keys agree in about log2(rows / window) leading bits.
    """
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    meet = agree ** max(1.0, math.log2(max(2, rows) / window))
    return max(8, math.ceil(math.log(1 - recall) / math.log1p(-meet))) if meet < 1 else 8


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges: every node but the least of its tree with that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _keys(m: np.ndarray, seed: int, p: int) -> np.ndarray:
    planes = np.random.default_rng([seed, p, m.shape[1]]).standard_normal((m.shape[1], _BITS))
    return (m @ planes > 0).astype(np.int64) @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))


def _near(ids: np.ndarray, m: np.ndarray, window: int, threshold: float, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of m at most `window` apart at the threshold; with split, only those that have row `split` between them."""
    for step in range(1, min(window, len(ids) - 1) + 1):
        near = np.einsum("ij,ij->i", m[:-step], m[step:]) >= threshold
        if split is not None:
            at = np.arange(len(near))
            near &= (at < split) & (at + step >= split)
        if near.any():
            yield ids[:-step][near], ids[step:][near]


_MET = "u string, v string, part int, side int, at int, pass int, vec array<double>"


def _pairs(got: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Rows of a forest of the pairs (side 0), and every 8th linked vector by digest (side 3), from which recall is estimated."""
    a, b = (np.concatenate(x).astype(str) for x in zip(*got, strict=True))
    child, top = _forest(np.where(a < b, a, b), np.where(a < b, b, a))
    some = [x for x in np.unique(np.concatenate([child, top])) if int(x[:8], 16) % 8 == 0]
    return pd.DataFrame({"u": [*child, *some], "v": [*top, *some], "part": -1, "side": [0] * len(child) + [3] * len(some), "at": 0})


def _pass_pairs(vectors: DataFrame, means: dict[int, np.ndarray], threshold: float, batch: list[int], window: int, seed: int) -> DataFrame:
    """Verified pairs of some passes from (id string, vec array<double>): rows (u, v, side, pass), side 0 a forest, 3 a sample."""

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for n, own in pdf.groupby(pdf["vec"].map(len)):
                m = _unit(_matrix(own["vec"])) - means[n]
                for p in batch:
                    yield pd.DataFrame({"pass": p, "dim": n, "key": _keys(m, seed, p), "id": own["id"].values, "vec": own["vec"].values})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs, and the first (side 1) and last (side 2) `window` rows of the part."""
        tail, part, head = None, 0, None
        for pdf in parts:
            part = int(pdf["part"].iloc[0])
            if head is None or len(head) < window:
                head = pdf.iloc[:window] if head is None else pd.concat([head, pdf.iloc[: window - len(head)]])
            before = 0 if tail is None else len(tail)
            if tail is not None:
                pdf = pd.concat([tail, pdf], ignore_index=True)
            for (p, _), own in pdf.groupby(["pass", "dim"], sort=False):
                m, ids, at = _unit(_matrix(own["vec"])), own["id"].to_numpy(), own.index.to_numpy()
                fresh = int(np.searchsorted(at, before))  # pairs inside the tail were given before
                got = list(_near(ids, m, window, threshold, fresh)) if fresh else []
                got += list(_near(ids[fresh:], m[fresh:], window, threshold))
                if got:
                    yield _pairs(got).assign(**{"pass": p, "vec": None})
            tail = pdf.iloc[-window:].reset_index(drop=True)
        for side, rows in ((1, head), (2, tail)):
            if rows is not None:
                yield pd.DataFrame({"u": rows["id"].values, "v": rows["dim"].astype(str).values, "part": part, "side": side, "at": range(len(rows)), "pass": rows["pass"].values, "vec": rows["vec"].values})

    ordered = (
        vectors.mapInPandas(keyed, "pass int, dim int, key long, id string, vec array<double>")
        .repartitionByRange("pass", "dim", "key", "id")
        .sortWithinPartitions("pass", "dim", "key", "id")
    )
    met = materialize(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(compare, _MET), "pairs")

    # each part's first rows meet the last rows of the parts before it: a few rows for each task of the sort
    held = [(r["part"], r["n"]) for r in met.where("side = 2").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    meet = []
    for k, (part, _) in enumerate(held):
        rows, j = 0, k - 1
        while j >= 0 and rows < window:
            meet.append((held[j][0], part, j - k))
            rows, j = rows + held[j][1], j - 1
    if not meet:
        return met.where("side in (0, 3)").select("u", "v", "side", "pass")
    to = F.broadcast(met.sparkSession.createDataFrame(meet, "part int, to int, back int"))
    heads = met.where("side = 1").withColumns({"to": F.col("part"), "back": F.lit(0)})
    both = met.where("side = 2").join(to, "part").unionByName(heads)

    def join_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (p, _), own in pdf.sort_values(["back", "at"]).groupby(["pass", "v"], sort=False):
            split = int((own["back"] < 0).sum())
            m = _unit(_matrix(own["vec"])) if 0 < split < len(own) else None
            got = list(_near(own["u"].to_numpy(), m, window, threshold, split)) if m is not None else []
            if got:
                out.append(_pairs(got)[["u", "v", "side"]].assign(**{"pass": p}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "side": [], "pass": []}).astype({"u": str, "v": str, "side": int, "pass": int})

    across = both.groupBy("to").applyInPandas(join_edges, "u string, v string, side int, pass int")
    return met.where("side in (0, 3)").select("u", "v", "side", "pass").unionByName(across)


def estimated_recall(met: DataFrame) -> float:
    """Share of linked vectors that passes have found linked, by Chao's estimate from how many were so in one pass, and how many in two."""
    often = met.where("side = 3").groupBy("u").agg(F.countDistinct("pass").alias("n"))
    r = often.agg(F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    unseen = r["one"] * (r["one"] - 1) / (2 * (r["two"] + 1))
    return r["all"] / (r["all"] + unseen) if r["all"] else 1.0


def candidate_pairs(vectors: DataFrame, rows: int, threshold: float, recall: float, together: int, window: int, seed: int) -> DataFrame:
    """Verified pairs (u, v), u < v, that connect what passes found, from (id string, vec array<double>).

    Vectors of different lengths never match. Passes go on after those that `rows` asks for until
    the estimated recall is reached or `together` more of them find no vector that is new to the sample.
    """

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for n, own in pdf.groupby(pdf["vec"].map(len)):
                s = _unit(_matrix(own["vec"])).sum(axis=0)
                yield pd.DataFrame({"dim": n, "at": range(n), "s": s, "n": len(own)})

    sums = vectors.mapInPandas(total, "dim int, at int, s double, n long").groupBy("dim", "at").agg((F.sum("s") / F.sum("n")).alias("mean"))
    means: dict[int, np.ndarray] = {}
    for r in sums.orderBy("dim", "at").collect():  # one mean vector for each dimension
        means.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["mean"]
    done, batch, found, seen = 0, passes_for(rows, threshold, window, recall), None, -1
    while True:
        met = materialize(_pass_pairs(vectors, means, threshold, list(range(done, done + batch)), window, seed), "met")
        found = met if found is None else found.unionByName(met)
        now = found.where("side = 3").select("u").distinct().count()
        if now == seen or estimated_recall(found) >= recall:
            return found.where("side = 0").select("u", "v").distinct()
        seen, done, batch = now, done + batch, together


def exact_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (id, n): for each vector the multiplicity-weighted number of other vectors of its component at or above the threshold.

    members has (id, vec, copies, root, blocks), blocks the number of blocks of the component. A
    vector's own further copies are not counted here.
    """
    dealt = members.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block b meets every block c: the row goes to the cells (b, c) as left side and (c, b) as right side
    cell = lambda c: F.struct(
        F.least("b", c).alias("x"), F.greatest("b", c).alias("y"), F.when(c == F.col("b"), 0).when(F.col("b") < c, 1).otherwise(2).alias("side")
    )
    cells = dealt.select("root", "id", "vec", "copies", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)).alias("cell"))
    spark = members.sparkSession
    rows = members.agg(F.sum(F.col("blocks").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-rows // (2 * block))))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(pdf["vec"].map(len)):
            ids, m, w = own["id"].to_numpy(), _unit(_matrix(own["vec"])), own["copies"].to_numpy()
            side = own["side"].to_numpy()
            if (side == 0).all():
                near = m @ m.T >= threshold
                np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"id": ids, "n": near @ w}))
            else:
                a, b = side == 1, side == 2
                near = m[a] @ m[b].T >= threshold
                out.append(pd.DataFrame({"id": ids[a], "n": near @ w[b]}))
                out.append(pd.DataFrame({"id": ids[b], "n": near.T @ w[a]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": []}).astype({"id": str, "n": "int64"})

    # the exchange deals the cells of one component over all tasks
    spread = cells.select("root", "cell.*", "id", "vec", "copies").repartition(parts, "root", "x", "y")
    return spread.groupBy("root", "x", "y").applyInPandas(count, "id string, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.99,
    together: int = 4,
    window: int = 32,
    block: int = 1024,
    seed: int = 20,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of table.

    Two vectors link if their cosine in double precision is at least `threshold` and a pass finds
    them or a component that passes found holds both. Null and zero vectors, and those with null or
    non-finite components, link with nothing (n_links 0, component their own id). Equal vectors,
    repeated rows included, link with one another. A null id takes part in links; its component is
    the smallest id reached, null if there is none. Extra columns are dropped; an empty table gives
    an empty result.
    """
    vec = F.col(vector).cast("array<double>")
    rows = materialize(
        table.select(F.col(id_col).alias("vec_id"), F.when(usable(vec), F.transform(vec, lambda x: x + F.lit(0.0))).alias("vec"))  # -0.0 becomes 0.0
        .withColumn("id", F.when(F.col("vec").isNotNull(), F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(k), "vec")), 16, "0")) for k in (1, 2)]))),
        "vectors",
    )
    total = rows.count()
    classes = materialize(
        rows.where("id is not null")
        .groupBy("id")
        .agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("hot", F.col("copies") * HOT_SHARE >= total),
        "classes",
    )
    pairs = materialize(candidate_pairs(classes.select("id", "vec"), classes.count(), threshold, recall, together, window, seed), "forest")
    found = materialize(components(pairs), "found")
    by_class = classes.select("id", "copies", "first_id").join(found, F.col("id") == F.col("node"), "left").select("id", "copies", "first_id", F.coalesce("root", "id").alias("root"))
    groups = materialize(
        by_class.groupBy("root")
        .agg(F.count("*").alias("n"), F.min("first_id").alias("component_id"))
        .select("root", "component_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"), (F.col("n") * HOT_SHARE >= total).alias("hot")),
        "groups",
    )
    named = materialize(join_hot(by_class, groups, "root"), "named")
    members = classes.select("id", "vec").join(named.join(found.select(F.col("node").alias("id")), "id", "left_semi"), "id").select("id", "vec", "copies", "root", "blocks")
    counted = exact_links(members, threshold, block)
    of_class = (
        named.join(counted, "id", "left")
        .join(classes.select("id", "hot"), "id")
        .select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id", "hot")
    )
    known = join_hot(rows.where("id is not null").select("vec_id", "id"), materialize(of_class, "of-class"), "id")
    alone = rows.where("id is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.select("vec_id", F.col("links").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("n_links", F.col("n_links").cast("long")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
