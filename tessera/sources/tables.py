"""Measurement text files, clinical tables, gating workspaces, and the parquet dataset."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import csv_subject
from ..operators.gates import GATE_ROW

# The columns of a measurement file.
META = ("Experiment_Name", "Condition_Name", "Image_Name", "Mito_ID")
FEATURES = (
    "Mito_Area", "Mito_Perimeter", "AreaPerimeter_Ratio", "Mito_MeanInt", "Mito_MeanInt_CORR", "Mito_MedianInt", "Mito_MedianInt_CORR",
    "Mito_TotalInt", "Mito_TotalInt_CORR", "Intensity_SD", "Intensity_SD_CORR", "Intensity_SD_percent", "Intensity_SD_percent_CORR",
    "Mito_CentroidX", "Mito_CentroidY", "Mito_Circularity", "Mito_Roundness", "Mito_Solidity", "Mito_AR", "Mito_Feret_Diameter",
    "Mito_FeretX", "Mito_FeretY", "Skewness", "Kurtosis", "CristaeOrientation_Major", "CristaeOrientation_Minor",
    "CristaeOrientation_Angle", "CristaeOrientation_Area",
)
NOT_ANALYSED = ("Mito_CentroidX", "Mito_CentroidY", "Mito_FeretX", "Mito_FeretY", "CristaeOrientation_Angle")
TEM_SCHEMA = T.StructType([T.StructField(c, T.IntegerType() if c == "Mito_ID" else T.StringType()) for c in META] + [T.StructField(c, T.DoubleType()) for c in FEATURES])


def read_measurements(spark: SparkSession, path: str, pattern: str = "*_MITO_measurements.txt") -> DataFrame:
    """All measurement files of a folder with source_filename; declared schema, checked against each header."""
    options = {"sep": "\t", "header": True, "enforceSchema": False, "pathGlobFilter": pattern, "mode": "FAILFAST"}
    return spark.read.schema(TEM_SCHEMA).options(**options).csv(path).withColumn("source_filename", F.col("_metadata.file_name"))


def file_problems(rows: DataFrame) -> DataFrame:
    """Files that can't be used, and why: areas that aren't positive, missing feature values."""
    missing = sum((F.col(f).isNull() | F.isnan(f)).cast("int") for f in FEATURES)
    got = rows.groupBy("source_filename").agg(
        F.sum(F.coalesce((F.col("Mito_Area") <= 0).cast("int"), F.lit(1))).alias("bad_area"), F.sum(missing).alias("missing"), F.count_distinct("Image_Name").alias("images")
    )
    return got.where("bad_area > 0 or missing > 0").select(
        "source_filename", F.when(F.col("missing") > 0, "missing feature values").otherwise("areas that are not positive").alias("error")
    )


def sanitize(name: str) -> str:
    """Letters without accents, digits and single underscores, in lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").lower()


def read_clinical(spark: SparkSession, path: str, missing: float = -1.0) -> DataFrame:
    """A row per subject (the last, if one occurs twice): subject_ID from the first column, numbers as double, the missing code as null."""
    raw = spark.read.options(header=True, multiLine=True).csv(path)
    names, taken = [], {}
    for c in raw.columns[1:]:
        s = sanitize(c)
        taken[s] = taken.get(s, 0) + 1
        names.append(s if taken[s] == 1 else f"{s}_{taken[s]}")
    rows = raw.toDF("_id", *names).withColumn("_at", F.monotonically_increasing_id()).withColumn("subject_ID", csv_subject(F.col("_id"))).where("subject_ID is not null")
    bad = rows.agg(*[F.count(F.when(F.col(n).isNotNull() & F.expr(f"try_cast(`{n}` as double)").isNull(), 1)).alias(n) for n in names]).first() if names else {}
    for n in names:
        number = F.expr(f"try_cast(`{n}` as double)")
        rows = rows.withColumn(n, F.when(number != missing, number) if not bad[n] else F.when(F.coalesce(number != missing, F.lit(True)), F.col(n)))
    last = Window.partitionBy("subject_ID").orderBy(F.col("_at").desc())
    return rows.withColumn("_rk", F.row_number().over(last)).where("_rk = 1").select("subject_ID", *names)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (stained_file, unstained_file, ...) of a CSV file with a header; a blank file name is null, and a stained file that comes twice is an error."""
    rows = spark.read.csv(path, header=True)
    if absent := {"stained_file", "unstained_file"} - set(rows.columns):
        raise ValueError(f"pairs without the columns {sorted(absent)}")
    named = rows.withColumns({c: F.when(F.trim(c) != "", F.trim(c)) for c in ("stained_file", "unstained_file")}).where("stained_file is not null")
    if twice := [r[0] for r in named.groupBy("stained_file").count().where("count > 1").orderBy("stained_file").limit(5).collect()]:
        raise ValueError(f"stained files with several partners, among them {twice}")
    return named


def enrich(events: DataFrame, clinical: DataFrame, key: str = "subject_ID") -> DataFrame:
    """Left join of the subject table, whose columns replace those of the same name; Spark chooses how by its size."""
    return events.drop(*[c for c in clinical.columns if c != key]).join(clinical, key, "left")


def parse_workspace(text: str) -> list[dict]:
    """One entry per gated population of a workspace: file, path, parent, type, channels, vertices or bounds, count, and how the sample's axes are drawn."""
    local = lambda e: e.tag.rpartition("}")[2]
    attr = lambda e, n: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == n), None)
    plain = lambda c: re.sub(r"^Comp-", "", c or "")
    out: list[dict] = []

    def walk(node, file: str, parent: str, scales: dict[str, str]) -> None:
        for pop in (p for s in node if local(s) == "Subpopulations" for p in s if local(p) == "Population"):
            path = f"{parent}/{pop.get('name')}" if parent != "root" else pop.get("name")
            for gate in (g for w in pop if local(w) == "Gate" for g in w):
                dims = [d for d in gate if local(d) == "dimension"]
                channels = [plain(attr(f, "name")) for d in dims for f in d if local(f) == "fcs-dimension"]
                bound = lambda d, n, other: float(attr(d, n)) if attr(d, n) is not None else other
                entry = {
                    "sample_file": file, "population_path": path, "name": pop.get("name"), "parent_path": parent, "gate_type": local(gate).removesuffix("Gate").lower(),
                    "channels": channels, "vertices": [], "bounds": [], "count": int(pop.get("count", -1)), "scales": scales,
                }
                if local(gate) == "PolygonGate":
                    entry["vertices"] = [[float(attr(c, "value")) for c in v if local(c) == "coordinate"] for v in gate if local(v) == "vertex"]
                if local(gate) == "RectangleGate":
                    entry["bounds"] = [[bound(d, "min", float("-inf")), bound(d, "max", float("inf"))] for d in dims]
                out.append(entry)
            walk(pop, file, path, scales)

    for sample in (s for s in ET.fromstring(text).iter() if local(s) == "Sample"):
        node = next((n for n in sample if local(n) == "SampleNode"), None)
        data = next((n for n in sample if local(n) == "DataSet"), None)
        file = unquote((data.get("uri") if data is not None else None) or (node.get("name") if node is not None else "")).rpartition("/")[2]
        drawn = (t for n in sample if local(n) == "Transformations" for t in n)
        scales = {plain(attr(p, "name")): local(t) for t in drawn for p in t if local(p) == "parameter"}
        if node is not None:
            walk(node, file, "root", scales)
    return out


GATES = GATE_ROW


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    """The gates of workspace files as a table; a file is parsed in one task."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in GATES.split(", ")]
        for pdf in parts:
            for content in pdf["content"]:
                yield pd.DataFrame([[g[c] for c in names] for g in parse_workspace(bytes(content).decode("utf-8"))], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, GATES)


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str = "source_filename") -> DataFrame:
    """Append the rows of files that the dataset at path doesn't have; returns what was new."""
    try:
        known = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = rows.select(key).limit(0)
    new = rows.join(known, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def check_same_schema(first: DataFrame, second: DataFrame, features: Sequence[str], other: Sequence[str]) -> None:
    """A union needs the same features in the same order."""
    if list(features) != list(other):
        raise ValueError(f"features differ: only in the first {sorted(set(features) - set(other))}, only in the second {sorted(set(other) - set(features))}")
