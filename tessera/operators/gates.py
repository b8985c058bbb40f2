"""Gates as predicates: populations of a workspace with their parents, and the two standard gates over folders' events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import asinh, in_polygon
from .quality import label_channel, scatter_gate

#: Divides values on a biexponential axis before the inverse hyperbolic sine that stands for it.
COFACTOR = 250.0


def shown(value: Column, scale: str) -> Column:
    """A value where its axis shows it."""
    if scale == "log":
        return F.log10(F.greatest(value, F.lit(1.0)))
    return asinh(value / COFACTOR) if scale == "biex" else value


def gate(row: Mapping, scales: Mapping[str, str] | None = None) -> Column:
    """Predicate of one gate, without its parents: half-open bounds of a rectangle, or a polygon as it is drawn on its axes."""
    scales = scales or {}
    names, axes = list(row["channels"]), [scales.get(c, "linear") for c in row["channels"]]
    if row["gate_type"] == "rectangle":
        inside = F.lit(True)
        for c, axis, (low, high) in zip(names, axes, row["bounds"], strict=True):
            v = F.greatest(F.col(c), F.lit(1.0)) if axis == "log" else F.col(c)
            inside = inside & (v >= F.lit(low)) & (v < F.lit(high))
        return inside
    if row["gate_type"] == "polygon":
        corners = [tuple(shown(F.lit(float(v)), a) for v, a in zip(p, axes, strict=True)) for p in row["vertices"]]  # as rows are shown: a row on a corner equals it
        return in_polygon(*[shown(F.col(c), a) for c, a in zip(names, axes, strict=True)], corners)
    raise NotImplementedError(f"gates of type {row['gate_type']}")


def populations(gates: Sequence[Mapping], scales: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Predicate of each population of one sample by path: its gate and those of all its parents."""
    by_path = {g["population_path"]: g for g in gates}
    out: dict[str, Column] = {}

    def of(path: str) -> Column:
        if path not in out:
            g = by_path[path]
            own = gate(g, scales)
            out[path] = own if g["parent_path"] in ("root", "") else of(g["parent_path"]) & own
        return out[path]

    for path in by_path:
        of(path)
    return out


#: Gates as a table; scales says how an axis is drawn (log, biex, or another: linear).
GATE_ROW = "sample_file string, population_path string, name string, parent_path string, gate_type string, channels array<string>, vertices array<array<double>>, bounds array<array<double>>, count long, scales map<string,string>"


def gate_rows(spark: SparkSession, gates: Sequence[Mapping] | DataFrame, scales: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Gates as a table, from one or from a list; given scales of a sample count before its own. Other types than rectangles and polygons raise NotImplementedError."""
    if isinstance(gates, DataFrame):
        table = gates if "scales" in gates.columns else gates.withColumn("scales", F.create_map().cast("map<string,string>"))
    else:
        names = [c.split()[0] for c in GATE_ROW.split(", ")]
        filled = ({"scales": {}, "name": g["population_path"].rpartition("/")[2], "vertices": [], "bounds": []} | dict(g) for g in gates)
        table = spark.createDataFrame([tuple(g[c] for c in names) for g in filled], GATE_ROW)
    if scales:
        given = spark.createDataFrame([(f, dict(m)) for f, m in scales.items()], "sample_file string, _given map<string,string>")
        table = table.join(given, "sample_file", "left").withColumn("scales", F.coalesce("_given", "scales")).drop("_given")
    other = table.where(~F.col("gate_type").isin("rectangle", "polygon")).select("gate_type").first()
    if other:
        raise NotImplementedError(f"gates of type {other[0]}")
    return table


def _prepared(table: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Rows (sample_file, gates): a sample's gates, parents first, with places of channels and corners where the axes show them."""
    scale = lambda c: F.coalesce(F.try_element_at("scales", c), F.lit("linear"))
    drawn = lambda v, s: F.when(s == "log", F.log10(F.greatest(v, F.lit(1.0)))).when(s == "biex", asinh(v / COFACTOR)).otherwise(v)
    sides = F.transform("channels", lambda c: F.struct((F.array_position(F.array(*map(F.lit, channels)), c) - 1).cast("int").alias("at"), scale(c).alias("scale")))
    corners = F.transform("vertices", lambda p: F.transform(p, lambda v, i: drawn(v, scale(F.get("channels", i)))))
    made = table.withColumns({"sides": sides, "corners": corners})
    edges = F.transform("corners", lambda p, i: F.struct(F.get(p, F.lit(0)).alias("x1"), F.get(p, F.lit(1)).alias("y1"), F.get(F.get("corners", (i + 1) % F.size("corners")), F.lit(0)).alias("x2"), F.get(F.get("corners", (i + 1) % F.size("corners")), F.lit(1)).alias("y2")))
    own = F.struct(F.size(F.split("population_path", "/")).alias("depth"), F.col("population_path").alias("path"), F.col("parent_path").alias("parent"), (F.col("gate_type") == "polygon").alias("polygon"), "sides", "bounds", edges.alias("edges"))
    return made.groupBy("sample_file").agg(F.array_sort(F.collect_list(own)).alias("gates"))  # a sample has few gates


def memberships(events: DataFrame, gates: DataFrame, file: str = "source_filename", name: str = "populations") -> DataFrame:
    """Events of the samples that gates (gate_rows()) are of, with an array of the paths of the populations they lie in, `root` first.

    Gates come to the events by a join on the sample, so the plan is of one size for any number of
    samples; a population is looked at for events within its parent only.
    """
    channels = sorted(r[0] for r in gates.select(F.explode("channels").alias("c")).distinct().collect())  # an instrument's channels
    missing = [c for c in channels if c not in events.columns]
    if missing:
        raise ValueError(f"channels are missing: {missing}")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in channels]) if channels else F.array().cast("array<double>")
    joined = events.withColumn("_v", values).join(_prepared(gates, channels).withColumnRenamed("sample_file", file), file)

    def inside(g: Column) -> Column:
        drawn = lambda side: F.when(side["scale"] == "log", F.log10(F.greatest(F.get("_v", side["at"]), F.lit(1.0)))).when(side["scale"] == "biex", asinh(F.get("_v", side["at"]) / COFACTOR)).otherwise(F.get("_v", side["at"]))
        floor = lambda side: F.when(side["scale"] == "log", F.greatest(F.get("_v", side["at"]), F.lit(1.0))).otherwise(F.get("_v", side["at"]))
        within = F.zip_with(g["sides"], g["bounds"], lambda side, b: (floor(side) >= F.get(b, F.lit(0))) & (floor(side) < F.get(b, F.lit(1))))
        box = F.forall(within, lambda ok: F.coalesce(ok, F.lit(False)))
        x, y = drawn(F.get(g["sides"], F.lit(0))), drawn(F.get(g["sides"], F.lit(1)))
        crossed = F.filter(
            g["edges"], lambda e: (e["y1"] != e["y2"]) & ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * ((e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
        )
        return F.when(g["polygon"], F.size(crossed) % 2 == 1).otherwise(box)

    step = lambda acc, g: F.when(F.array_contains(acc, F.when(g["parent"] == "", "root").otherwise(g["parent"])) & inside(g), F.array_append(acc, g["path"])).otherwise(acc)
    return joined.withColumn(name, F.aggregate("gates", F.array(F.lit("root")), step)).drop("_v", "gates")


def replay(events: DataFrame, gates: Sequence[Mapping] | DataFrame, file: str = "source_filename", scales: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Rows (sample_file, population_path, n, parent_n, stored, difference_pct_of_parent), one for each gate; one aggregation of the events.

    gates are those of read_workspace(), as a table or a list; difference is 100 (n - stored) / parent_n.
    """
    table = gate_rows(events.sparkSession, gates, scales)
    listed = table.select("sample_file", "population_path", F.when(F.col("parent_path") == "", "root").otherwise(F.col("parent_path")).alias("parent_path"), F.col("count").alias("stored"))
    seen = memberships(events, table, file, "_paths")
    counts = seen.select(F.col(file).alias("sample_file"), F.explode("_paths").alias("population_path")).groupBy("sample_file", "population_path").agg(F.count("*").alias("n"))
    parents = counts.select("sample_file", F.col("population_path").alias("parent_path"), F.col("n").alias("parent_n"))
    n = F.coalesce("n", F.lit(0))
    return (
        listed.join(counts, ["sample_file", "population_path"], "left")
        .join(parents, ["sample_file", "parent_path"], "left")
        .select("sample_file", "population_path", n.alias("n"), F.coalesce("parent_n", F.lit(0)).alias("parent_n"), "stored", (100 * (n - F.col("stored")) / F.nullif(F.col("parent_n"), F.lit(0))).alias("difference_pct_of_parent"))
    )


def label_gate(events: DataFrame, inside: Column, name: str) -> DataFrame:
    """events with a label channel: 2000 inside the gate, 6000 outside (nulls too)."""
    return events.withColumn(name, label_channel(F.coalesce(inside, F.lit(False))))


def gate_summary(events: DataFrame, inside: Column, file: str = "source_filename") -> DataFrame:
    """Per file: events, kept, percent kept."""
    kept = F.count_if(F.coalesce(inside, F.lit(False)))
    return events.groupBy(file).agg(F.count("*").alias("events"), kept.alias("kept"), (100 * kept / F.count("*")).alias("pct_kept"))


def gate_p1(events: DataFrame, scatter: Mapping[str, float | None], least: float = 1.0, file: str = "source_filename") -> tuple[DataFrame, DataFrame]:
    """Events in the scatter gate, and the summary by file."""
    inside = scatter_gate(dict(scatter), least)
    return events.where(inside), gate_summary(events, inside, file)


def gate_stained(
    events: DataFrame, pairs: DataFrame, channel: str, quantile: float = 0.999, tail_alert: float = 0.867, sensitivity_alert: float = 44.8, file: str = "source_filename"
) -> tuple[DataFrame, DataFrame]:
    """Events of stained files above the threshold of their pooled unstained files, and a row per stained file.

    pairs: rows (stained_file, unstained_file), several unstained files of a stained one are pooled.
    Thresholds come from a join of the events with pairs and one aggregation. The summary has
    threshold, tail_spread (in display units), pct_positive, sensitivity_points and an alert.
    """
    quantiles = [0.99, quantile, 0.9999]
    base = events.select(F.col(file).alias("unstained_file"), F.col(channel).cast("double").alias("v")).join(pairs, "unstained_file")
    q = base.groupBy("stained_file").agg(F.percentile("v", F.array(*[F.lit(x) for x in quantiles])).alias("q"))
    stained = events.join(q.withColumnRenamed("stained_file", file), file)
    above = lambda k: F.col(channel) > F.get("q", F.lit(k))
    share = lambda k: 100 * F.avg(above(k).cast("double"))
    spread = F.asinh(F.get("q", F.lit(2)) / COFACTOR) - F.asinh(F.get("q", F.lit(0)) / COFACTOR)
    summary = stained.groupBy(file).agg(
        F.count("*").alias("events"),
        F.first(F.get("q", F.lit(1))).alias("threshold"),
        F.first(spread).alias("tail_spread"),
        share(1).alias("pct_positive"),
        (share(0) - share(2)).alias("sensitivity_points"),
    )
    alert = F.concat_ws("; ", F.when(F.col("tail_spread") > tail_alert, "wide unstained tail"), F.when(F.col("sensitivity_points") > sensitivity_alert, "sensitive to the quantile"))
    return stained.where(above(1)).drop("q"), summary.withColumn("alert", F.nullif(alert, F.lit("")))
