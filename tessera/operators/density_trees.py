"""HDBSCAN of a table of any number of rows.

Rows that lie alike are met as one, which counts as often as there are such. Cuts at medians lay the
rows in cells of near ones. A row's k-th nearest one is looked for in its own cell, then in those that
the ball found so far reaches. The least spanning tree under mutual reachability begins within the
cells: an edge is taken if one side of it has no row whose way to another cell is as short. Borůvka
rounds do the rest: each component but the largest takes its least edge out. A row looks for it in
its own cell, which bounds the component's edge, then in those cells within that bound that hold
others. Edges have a total order (weight, ends), so there is one such tree, and cells don't matter.

What is left for one task is the tree itself, rows - 1 edges of three numbers; it is sorted, merged
and condensed there. No task holds more features than those of a cell and of the rows that visit it.
The driver holds a row per cell, and for the cuts a bounded number of rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import written
from .density import labels_of_tree, spanning_tree

EDGE = "u long, v long, w double"


def _numbered(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows (id, key..., x): known rows, numbered in order of key; written, so that the numbers stay."""
    known = df.dropna(subset=list(features))
    known = known.where(~sum((F.isnan(F.col(f).cast("double")).cast("int") for f in features), F.lit(0)).cast("boolean"))
    return written(known.orderBy(*key).select(F.monotonically_increasing_id().alias("id"), *key, F.array(*[F.col(f).cast("double") for f in features]).alias("x")), "points")


def _cuts(x: np.ndarray, parts: int) -> tuple | None:
    """Nested (column, cut, below, above) with about `parts` leaves (None), from a sample of rows; each cut is at the median of the widest column."""
    width = np.ptp(x, axis=0) if len(x) else np.zeros(1)
    if parts < 2 or not width.max() > 0:
        return None
    j = int(width.argmax())
    values = np.sort(x[:, j])
    cut = values[(len(values) - 1) // 2]
    if cut == values[-1]:
        cut = values[values < cut].max()
    low = x[:, j] <= cut
    below = min(max(round(parts * float(low.mean())), 1), parts - 1)
    return j, float(cut), _cuts(x[low], below), _cuts(x[~low], parts - below)


def _cell_of(x: np.ndarray, cuts: tuple | None) -> np.ndarray:
    out, last = np.zeros(len(x), dtype=np.int64), 0
    todo = [(cuts, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if node is None:
            out[at], last = last, last + 1
            continue
        low = x[at, node[0]] <= node[1]
        todo += [(node[3], at[~low]), (node[2], at[low])]
    return out


class _Cells(NamedTuple):
    """What the driver knows of the cells: names, boxes, rows, least and greatest core distance and component."""

    names: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    core: np.ndarray
    component: np.ndarray

    @staticmethod
    def of(placed: DataFrame, xs: Sequence[str]) -> _Cells:
        more = [c for c in ("core", "c") if c in placed.columns]
        ends = [f(c) for c in (*xs, *more) for f in (F.min, F.max)]
        got = placed.groupBy("cell").agg(F.sum("copies"), *ends).orderBy("cell").toPandas()  # a row per cell
        ends = {c: got[[f"min({c})", f"max({c})"]].to_numpy() for c in (*xs, *more)}
        low, high = (np.stack([ends[c][:, k] for c in xs], axis=1) for k in (0, 1))
        return _Cells(got["cell"].to_numpy(), low, high, got["sum(copies)"].to_numpy(), ends.get("core"), ends.get("c"))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have to each row of x."""
        total = np.zeros((len(x), len(self.names)))
        for j in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, j] - x[:, None, j], x[:, None, j] - self.high[None, :, j]), 0)
            total += gap * gap
        return np.sqrt(total) * (1 - 1e-12)

    def farthest(self, x: np.ndarray) -> np.ndarray:
        """The greatest distance likewise."""
        total = np.zeros((len(x), len(self.names)))
        for j in range(x.shape[1]):
            gap = np.maximum(np.abs(self.low[None, :, j] - x[:, None, j]), np.abs(self.high[None, :, j] - x[:, None, j]))
            total += gap * gap
        return np.sqrt(total) * (1 + 1e-12)


def _parts(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows, so that a matrix of that width stays small."""
    step = max(1, 2_000_000 // max(width, 1))
    yield from (slice(a, a + step) for a in range(0, rows, step))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, None, j] - b[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def _nearest_copies(d: np.ndarray, copies: np.ndarray, k: int) -> list[list[float]]:
    """The k least distances of each line of d, each as often as its row has copies."""
    out = []
    for line in d:
        at = np.argpartition(line, k - 1)[:k] if len(line) > k else np.arange(len(line))
        at = at[np.argsort(line[at])]
        out.append(np.repeat(line[at], np.minimum(copies[at], k))[:k].tolist())
    return out


def core_distances(placed: DataFrame, xs: Sequence[str], k: int, cells: _Cells) -> DataFrame:
    """Rows (id, core): the distance to the k-th nearest row, the row itself and copies included."""
    xs = list(xs)
    kinds = ", ".join(f"{c} double" for c in xs)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, copies, cell = pdf[xs].to_numpy(), pdf["copies"].to_numpy(), pdf["cell"].iloc[0]
        near, others = [], []
        for s in _parts(len(x), len(x)):
            near += _nearest_copies(_distances(x[s], x), copies, k)
        for s in _parts(len(x), len(cells.names)):
            radius = np.array([d[k - 1] if len(d) == k else np.inf for d in near[s]])
            if np.isinf(radius).any():  # the cells that hold k rows between them bound it
                far = cells.farthest(x[s])
                order = np.argsort(far, axis=1)
                enough = (np.cumsum(cells.n[order], axis=1) >= k).argmax(axis=1)
                radius = np.minimum(radius, far[np.arange(len(far)), order[np.arange(len(far)), enough]])
            reach = (cells.nearest(x[s]) <= radius[:, None]) & (cells.names != cell)
            others += [cells.names[line].tolist() for line in reach]
        return pdf[["id", *xs]].assign(near=near, others=others)

    first = written(placed.groupBy("cell").applyInPandas(own, f"id long, {kinds}, near array<double>, others array<long>"), "near")

    def visit(visitors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        q, x, copies = visitors[xs].to_numpy(), rows[xs].to_numpy(), rows["copies"].to_numpy()
        near: list = []
        for s in _parts(len(q), len(x)):
            near += _nearest_copies(_distances(q[s], x), copies, k)
        return pd.DataFrame({"id": visitors["id"], "near": pd.Series(near, index=visitors.index, dtype=object)})

    away = first.where(F.size("others") > 0)
    asked = away.select("id", *xs, F.explode("others").alias("cell")).groupBy("cell")
    found = asked.cogroup(placed.groupBy("cell")).applyInPandas(visit, "id long, near array<double>")
    both = away.select("id", "near").unionByName(found).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return first.where(F.size("others") == 0).select("id", "near").unionByName(both).select("id", F.get("near", F.lit(k - 1)).alias("core"))


def within_cells(reach: DataFrame, xs: Sequence[str], cells: _Cells) -> DataFrame:
    """reach with c, the least id of a component of edges of the tree, and those edges (u, v, w), one beside a row as far as they go."""
    xs = list(xs)
    columns = ["id", "cell", "copies", "core", *xs]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, core, ids = pdf[xs].to_numpy(), pdf["core"].to_numpy(), pdf["id"].to_numpy()
        other = cells.names != pdf["cell"].iloc[0]
        out = np.full(len(x), np.inf)  # no edge to another cell weighs less
        if other.any():
            for s in _parts(len(x), len(other)):
                out[s] = np.maximum(cells.nearest(x[s])[:, other].min(axis=1), core[s])
        own, kept = list(range(len(x))), list(range(len(x)))

        def find(parent: list[int], i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        taken = []
        for w, a, b in spanning_tree(x, core):
            i, j = sorted((find(own, a), find(own, b)))
            if w < out[i] or w < out[j]:
                taken.append((ids[a], ids[b], w))
                p, q = sorted((find(kept, a), find(kept, b)))
                kept[q] = p
            own[j] = i
            out[i] = min(out[i], out[j])
        u, v, w = zip(*taken, strict=True) if taken else ((), (), ())
        blank = [None] * (len(x) - len(taken))
        got = pdf[columns].assign(c=ids[[find(kept, i) for i in range(len(x))]])
        return got.assign(u=pd.array([*u, *blank], dtype="Int64"), v=pd.array([*v, *blank], dtype="Int64"), w=[*w, *blank])

    kinds = ", ".join(f"{c} double" for c in ("core", *xs))
    return reach.groupBy("cell").applyInPandas(grow, f"id long, cell long, copies long, {kinds}, c long, u long, v long, w double")


def _least_out(q: pd.DataFrame, rows: pd.DataFrame, xs: list[str]) -> pd.DataFrame:
    """q's least edge (w, u, v, other) to rows of other components; infinite where there is none. rows: in order of id."""
    x, core, ids, c = rows[xs].to_numpy(), rows["core"].to_numpy(), rows["id"].to_numpy(), rows["c"].to_numpy()
    qx, qcore, qc = q[xs].to_numpy(), q["core"].to_numpy(), q["c"].to_numpy()
    w, to = np.empty(len(q)), np.empty(len(q), dtype=np.int64)
    for s in _parts(len(q), len(x)):
        d = np.maximum(np.maximum(_distances(qx[s], x), qcore[s, None]), core)
        d[qc[s, None] == c] = np.inf
        to[s] = d.argmin(axis=1)  # of equal ones the least id, which makes the least pair of ends
        w[s] = d[np.arange(len(d)), to[s]]
    a, b = q["id"].to_numpy(), ids[to]
    return pd.DataFrame({"c": qc, "w": w, "u": np.minimum(a, b), "v": np.maximum(a, b), "other": c[to]})


def _best(edges: DataFrame) -> DataFrame:
    return edges.where("w < double('infinity')").groupBy("c").agg(F.min(F.struct("w", "u", "v", "other")).alias("e"))


def _round(at: DataFrame, xs: Sequence[str], cells: _Cells, largest: int) -> DataFrame:
    """Rows (c, e): the least edge out of each component but the largest, e = (w, u, v, other)."""
    xs = list(xs)
    kinds = ", ".join(f"{c} double" for c in ("core", *xs))
    pure = np.where(cells.component[:, 0] == cells.component[:, 1], cells.component[:, 0], -1)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        q = pdf[pdf["c"] != largest].reset_index(drop=True)
        if q.empty:
            return pd.DataFrame(columns=["id", "cell", "core", *xs, "c", "w", "u", "v", "other", "far"])
        got = _least_out(q, pdf, xs).drop(columns="c")
        far, x, c = np.empty(len(q)), q[xs].to_numpy(), q["c"].to_numpy()
        for s in _parts(len(q), len(pure)):
            most = np.maximum(cells.farthest(x[s]), cells.core[:, 1])
            most[pure == c[s, None]] = np.inf
            far[s] = np.maximum(most.min(axis=1), q["core"].to_numpy()[s])
        return pd.concat([q[["id", "cell", "core", *xs, "c"]], got], axis=1).assign(far=far)

    edge = "w double, u long, v long, other long"
    first = written(at.groupBy("cell").applyInPandas(own, f"id long, cell long, {kinds}, c long, {edge}, far double"), "first")
    bound = first.groupBy("c").agg(F.min(F.least("w", "far")).alias("bound"))

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s in _parts(len(pdf), len(pure)):
                q = pdf.iloc[s]
                c, most = q["c"].to_numpy()[:, None], q["bound"].to_numpy()[:, None]
                go = (cells.nearest(q[xs].to_numpy()) <= most) & (cells.core[:, 0] <= most) & (pure != c) & (cells.names != q["cell"].to_numpy()[:, None])
                row, to = np.nonzero(go)
                yield q.iloc[row][["id", "core", *xs, "c"]].assign(cell=cells.names[to])

    asked = first.join(bound, "c").where("core <= bound").select("id", "cell", "core", *xs, "c", "bound").mapInPandas(route, f"id long, {kinds}, c long, cell long")

    def visit(visitors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty:
            return pd.DataFrame(columns=["c", "w", "u", "v", "other"])
        got = _least_out(visitors, rows.sort_values("id"), xs)
        return got.sort_values(["c", "w", "u", "v"]).drop_duplicates("c")

    found = asked.groupBy("cell").cogroup(at.groupBy("cell")).applyInPandas(visit, f"c long, {edge}")
    return _best(first.select("c", "w", "u", "v", "other").unionByName(found))


def spanning_edges(reach: DataFrame, xs: Sequence[str], cells: _Cells) -> DataFrame:
    """Edges (u, v, w) of the least spanning tree of rows apart. reach: (id, cell, copies, core, xs...)."""
    grown = written(within_cells(reach, xs, cells), "grown")
    tree, at = grown.where("u is not null").select("u", "v", "w"), grown.drop("u", "v", "w")
    while True:
        top = at.groupBy("c").agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.max(F.struct("n", "c")).alias("top")).first()
        if top["k"] < 2:
            return tree
        largest = top["top"]["c"]
        best = written(_round(at, xs, _Cells.of(at, xs), largest), "best")
        tree = tree.unionByName(best.select("e.u", "e.v", "e.w").distinct())
        roots = _roots(best, largest)
        at = written(at.join(roots, "c").withColumn("c", F.col("root")).drop("root"), "at")


def edges_of_copies(points: DataFrame, apart: DataFrame, reach: DataFrame, xs: Sequence[str], cells: _Cells) -> DataFrame:
    """Edges (u, v, w) by which copies join the tree of rows apart: each at its core distance, to the least id that is as near and no sparser."""
    xs = list(xs)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s in _parts(len(pdf), len(cells.names)):
                q = pdf.iloc[s]
                row, to = np.nonzero(cells.nearest(q[xs].to_numpy()) <= q["core"].to_numpy()[:, None])
                yield q.iloc[row].assign(cell=cells.names[to])

    def visit(visitors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, core, ids, least = rows[xs].to_numpy(), rows["core"].to_numpy(), rows["id"].to_numpy(), []
        for s in _parts(len(visitors), len(x)):
            own = visitors["core"].to_numpy()[s, None]
            fits = (_distances(visitors[xs].to_numpy()[s], x) <= own) & (core <= own)
            least += np.where(fits.any(axis=1), ids[fits.argmax(axis=1)], np.iinfo(np.int64).max).tolist()
        return pd.DataFrame({"id": visitors["id"], "least": pd.Series(least, index=visitors.index, dtype="int64")})

    kinds = ", ".join(f"{c} double" for c in ("core", *xs))
    asked = reach.where("copies > 1").select("id", "core", *xs).mapInPandas(route, f"id long, {kinds}, cell long")
    to = asked.groupBy("cell").cogroup(reach.groupBy("cell")).applyInPandas(visit, "id long, least long").groupBy("id").agg(F.min("least").alias("u"))
    own = apart.where("copies > 1").select(F.col("id").alias("rep"), "x").join(reach.select(F.col("id").alias("rep"), "core"), "rep").join(to.withColumnRenamed("id", "rep"), "rep")
    return points.select(F.col("id").alias("v"), "x").join(own, "x").where("v <> rep").select("u", "v", F.col("core").alias("w"))


def _roots(best: DataFrame, settled: int | None = None) -> DataFrame:
    """Rows (c, root) from each component's choice (c, e), e = (w, u, v, other): pointers are followed until they stay. The component `settled` chose none."""
    back = best.select(F.col("c").alias("p"), F.struct("e.w", "e.u", "e.v").alias("back"))
    to = best.select("c", F.col("e.other").alias("p"), F.struct("e.w", "e.u", "e.v").alias("own"))
    # two components that chose one edge point at each other; the smaller is the root
    at = to.join(back, "p", "left").select("c", F.when((F.col("own") == F.col("back")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    if settled is not None:
        at = at.unionByName(best.sparkSession.range(1).select(F.lit(settled).cast("long").alias("c"), F.lit(settled).cast("long").alias("p")))
    while True:
        at = written(at, "pointers")
        hop = lambda t: t.join(at.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p"))  # noqa: B023, E731
        far = hop(hop(hop(at)))
        if at.join(far.withColumnRenamed("p", "far"), "c").where("p <> far").isEmpty():
            return at.select("c", F.col("p").alias("root"))
        at = far


def least_spanning_tree(edges: DataFrame) -> DataFrame:
    """Edges (u, v, w) of the least spanning forest of a table of edges, by Borůvka's rounds."""
    between = written(edges.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w")).select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")), "edges")
    tree: DataFrame | None = None
    while not between.isEmpty():
        ends = between.select(F.col("a").alias("c"), F.col("b").alias("other"), "e").unionByName(between.select(F.col("b").alias("c"), F.col("a").alias("other"), "e"))
        best = written(ends.groupBy("c").agg(F.min(F.struct("e.w", "e.u", "e.v", "other")).alias("e")), "best")
        chosen = best.select("e.u", "e.v", "e.w").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        roots = _roots(best)
        a, b = (roots.select(F.col("c").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
        moved = between.join(a, "a").join(b, "b").where("ra <> rb")
        between = written(moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")), "edges")
    return tree if tree is not None else edges.limit(0)


def hdbscan(df: DataFrame, key: Sequence[str], features: Sequence[str], min_cluster_size: int = 5, min_samples: int | None = None, block: int = 1024, name: str = "cluster") -> DataFrame:
    """Rows (key..., cluster) by excess of mass, the clusters of density.hdbscan: 0.. by size, of equal ones that with the earliest row first; -1 is noise.

    Rows with a missing feature are left out. `block` is about the number of rows in a cell. Rows
    with equal keys are rows of their own; a table of fewer rows than min_cluster_size is noise.
    """
    points = _numbered(df, key, features)
    n = points.count()
    if n < max(2, min_cluster_size):
        return points.select(*key, F.lit(-1).cast("long").alias(name))
    xs = [f"x{j}" for j in range(len(features))]
    apart = written(points.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "apart")
    n_apart = apart.count()
    wide = apart.select("id", "copies", *[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(xs)])
    parts = -(-n_apart // block)
    every = max(1, n_apart // (64 * parts))
    cuts = _cuts(wide.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(*xs).toPandas().to_numpy(), parts) if parts > 1 else None  # about 64 rows a cell

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=_cell_of(pdf[xs].to_numpy(), cuts))

    placed = written(wide.mapInPandas(place, f"id long, copies long, {', '.join(f'{c} double' for c in xs)}, cell long"), "placed")
    cells = _Cells.of(placed, xs)
    cores = core_distances(placed, xs, min(min_samples or min_cluster_size, n), cells)
    reach = written(placed.join(cores, "id"), "cores")
    cells = _Cells.of(reach, xs)
    edges = spanning_edges(reach, xs, cells)
    if n_apart < n:
        edges = edges.unionByName(edges_of_copies(points, apart, reach, xs, cells))
    tree = written(edges, "tree")

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(parts, ignore_index=True).sort_values(["w", "u", "v"])
        if got.empty:
            return
        ids, ends = np.unique(got[["u", "v"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        edges = list(zip(got["w"].tolist(), ends[:, 0].tolist(), ends[:, 1].tolist(), strict=True))
        labels = labels_of_tree(edges, len(ids), min_cluster_size)
        found, first, sizes = np.unique(labels[labels >= 0], return_index=True, return_counts=True)
        place = np.empty(len(found), dtype=int)
        place[np.lexsort((np.flatnonzero(labels >= 0)[first], -sizes))] = np.arange(len(found))
        yield pd.DataFrame({"id": ids, name: np.where(labels >= 0, place[np.searchsorted(found, np.maximum(labels, 0))] if len(found) else -1, -1)})

    labels = tree.repartition(1).mapInPandas(label, f"id long, {name} long")  # edges only
    return points.select("id", *key).join(labels, "id").drop("id")
