"""Folders of measurement files to one annotated table.

A files table (a row per file, from names and headers alone) is checked before any event is read:
what a name says, what its header declares, whether its channels are those of the first file. Files
that fail have a status and an error there and are left out; the others are read in one scan, and
what is known of a file comes to its rows by a join on source_filename.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..functions import images, tokens
from . import fcs, tables
from .dataset import Dataset

# The keywords that are kept.
INSTRUMENT = (
    "cyt", "cytsn", "inst", "date", "btim", "etim", "op", "mode", "byteord", "datatype", "tot", "par", "fj_fcs_version", "timestep",
    "apply compensation", "laser1name", "laser2name", "laser3name", "laser4name", "laser5name",
)
OF_ROWS = ("date", "tubename", "vol", "tot")
#: Columns that the ingestion writes itself.
RESERVED = (
    "source_filename", "event_no", "specie", "subject_ID", "age", "diet", "age_group", "treatment", "dilution", "marker", "FlowAI_Pass", "condition",
    "number_of_additions", "minutes_after_last_addition", *(f"fcs_{k}" for k in OF_ROWS),
)


def is_metadata(word: str) -> bool:
    """Whether a word of a file name has a fixed meaning."""
    own = {*tokens.SPECIES, *tokens.TREATMENTS, *tokens.SILENT, *tokens.MARKERS, *tokens.PASS_TOKENS, *tokens.DIETS, *tokens.AGE_GROUPS, "ND"}
    age = len(word) == 3 and word[0] in tokens.AGE_BOUNDS and word[1:].isdigit()
    return word in own or age or (len(word) == 3 and word.isdigit())


def fcs_headers(spark: SparkSession, path: str, pattern: str = "*.[fF][cC][sS]") -> DataFrame:
    """A row per file, decoded where it lies: source_filename, channels, descriptions, ranges, events, keywords, error (null if it can be read)."""

    def head(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                row: dict = {"source_filename": name, "channels": None, "descriptions": None, "ranges": None, "events": 0, "keywords": None, "error": None}
                try:
                    ev = fcs.parse(bytes(content))
                    keep = {k: v for key in dict.fromkeys((*INSTRUMENT, *OF_ROWS)) if (v := ev.text.get(key, ev.text.get("$" + key))) is not None for k in (key,)}
                    row |= {"channels": ev.names, "descriptions": ev.descriptions, "ranges": list(ev.ranges().values()), "events": len(ev.values), "keywords": keep}
                    row["error"] = None if len(ev.values) else "no events"
                except fcs.FcsError as e:
                    row["error"] = str(e)
                yield pd.DataFrame([row])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    schema = "source_filename string, channels array<string>, descriptions array<string>, ranges array<double>, events long, keywords map<string,string>, error string"
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").mapInPandas(head, schema)


def name_columns(name: Column, products: Sequence[str] = (), columns: Mapping[str, Mapping[str, str]] | None = None, species: str | None = None) -> dict[str, Column]:
    """Columns that the words of a file name give."""
    words = tokens.words(name)
    declared = columns or {}
    known = (*(w for values in declared.values() for w in values), *tokens.SPECIES, *tokens.TREATMENTS, *tokens.SILENT)
    spoken = tokens.condition(words, tuple(products), known)
    out = {
        "specie": F.lit(species) if species else tokens.specie(words),
        "subject_ID": tokens.subject_id(words),
        "age": tokens.age(words).cast("float"),
        "diet": tokens.one_of(words, tokens.DIETS),
        "age_group": tokens.age_group(words),
        "treatment": tokens.treatment(words),
        "dilution": tokens.dilution(words),
        "marker": tokens.marker(words),
        "FlowAI_Pass": tokens.qc_pass(words),
        "condition": spoken["condition"],
        "number_of_additions": spoken["additions"],
        "minutes_after_last_addition": spoken["minutes"],
        "unrecognised": spoken["unrecognised"],
    }
    out |= {f"with_{p}": F.array_contains(words, p) for p in products}
    return out | {c: tokens.declared_column(words, values) for c, values in declared.items()}


def condition_order(files: DataFrame) -> DataFrame:
    """Rows (condition, condition_order): fewer additions first, then shorter waits (none before any), then the label; a label's first place counts."""
    place = F.min(F.struct("number_of_additions", F.coalesce("minutes_after_last_addition", F.lit(-1.0)).alias("wait"), "condition"))
    by = files.groupBy("condition").agg(place.alias("place"))
    return by.select("condition", F.row_number().over(Window.orderBy("place")).cast("int").alias("condition_order"))  # a row per condition


def annotate(rows: DataFrame, products: Mapping[str, str] | None = None, columns: Mapping[str, Mapping[str, str]] | None = None, species: str | None = None) -> DataFrame:
    """rows with what their file names say, columns of these names replaced; each name is parsed once and comes back by a join."""
    ch.check_products(products or {}, is_metadata)
    ch.check_columns(columns or {}, is_metadata, products, RESERVED)
    named = rows.select("source_filename").distinct().withColumns(name_columns(F.col("source_filename"), tuple(products or ()), columns, species))
    named = named.join(condition_order(named), "condition", "left")
    return rows.drop(*[c for c in named.columns if c != "source_filename"]).join(named, "source_filename")


def unused_words(files: DataFrame, columns: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rows (column, word): declared words that no file name has."""
    spark = files.sparkSession
    declared = spark.createDataFrame([(c, w) for c, values in columns.items() for w in values], "column string, word string")
    said = files.select(F.explode(tokens.words(F.col("source_filename"))).alias("word")).distinct()
    return declared.join(said, "word", "left_anti").select("column", "word")


def check_names(files: DataFrame, columns: Mapping[str, Mapping[str, str]]) -> None:
    """Raises if a name has words of two values of one declared column; names only, before anything is read."""
    for c, values in columns.items():
        said = F.array_distinct(F.transform(F.filter(tokens.words(F.col("source_filename")), lambda t: t.isin(*values)), lambda t: tokens.lookup(values, t)))  # noqa: B023
        worst = files.where(F.size(said) > 1).select("source_filename").first()
        if worst:
            raise ValueError(f"{worst[0]} has words of several values of column {c}")


def ingest_fcs(
    spark: SparkSession,
    folder: str,
    out: str,
    exclude: Sequence[str] | None = None,
    products: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    append: bool = False,
    species: str | None = None,
) -> DataFrame:
    """Read a folder's FCS files into a dataset (its rows under out/events) and return its files table (status, error).

    Declarations and names are checked before anything is read. Files that can't be read, or whose
    channels aren't those of the first good one in order of names, are left out; ValueError if none
    is good. With append, files that the dataset has are skipped, those that failed before are tried
    again, and all must fit its channels; without, the dataset is replaced. See Dataset for what
    happens when a run dies.
    """
    ch.check_products(products or {}, is_metadata)
    ch.check_columns(columns or {}, is_metadata, products, RESERVED)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[fF][cC][sS]").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_filename"))
    if listed.isEmpty():
        raise ValueError(f"no FCS file in {folder}")
    check_names(listed, columns or {})
    heads = fcs_headers(spark, folder).persist()
    try:
        data = Dataset(spark, out, "events")
        append = append and bool(data.runs())
        fresh = data.missing(heads) if append else heads
        base = data.files().where("status = 'ok'") if append else heads.where("error is null")
        first = base.orderBy("source_filename").select("channels").first()
        if first is None:
            raise ValueError(f"no FCS file of {folder} can be read")
        names = ch.kept(first["channels"], exclude)
        ch.warn_unlisted(first["channels"], folder)
        same = F.col("channels") == F.array(*[F.lit(c) for c in first["channels"]])
        error = F.coalesce("error", F.when(~same, F.lit("channels that differ from the first file's")))
        files = (
            fresh.withColumn("error", error)
            .withColumn("status", F.when(error.isNull(), "ok").otherwise("failed"))
            .withColumns({f"fcs_{k}": F.col("keywords")[k] for k in OF_ROWS})
        )
        good = files.where("status = 'ok'").select("source_filename", *[f"fcs_{k}" for k in OF_ROWS])
        events = fcs.read(spark, folder, names).where("event_no is not null").drop("error").join(good, "source_filename")
        events = events.withColumns({c: F.col(c).cast("float") for c in names})
        data.write(annotate(events, products, columns, species), files, {"features": names}, replace=not append, expected="events")
    finally:
        heads.unpersist()
    return data.files()


def ingest_measurements(spark: SparkSession, folder: str, out: str, specie: str | None = None, from_names: bool = True, append: bool = False) -> DataFrame:
    """Read a folder's measurement files into a dataset (its rows under out/rows) and return its files table.

    With from_names, species, subject, condition and diet come from the name (a name's condition
    counts before the file's); without, `specie` is given, the subject is the file's place in order
    of names, and the condition the file's. Files with bad values are left out; RuntimeError if
    none is good. With append, files that the dataset has are skipped and those that failed before
    are tried again; without, the dataset is replaced.
    """
    if not from_names and not specie:
        raise ValueError("a species is needed where names aren't read")
    data = Dataset(spark, out)
    append = append and bool(data.runs())
    rows = tables.read_measurements(spark, folder)
    rows = data.missing(rows) if append else rows
    of_file = rows.groupBy("source_filename").agg(F.count("*").alias("n_rows"), F.min("Image_Name").alias("image"), F.min("Condition_Name").alias("from_file"), F.count_distinct("Image_Name").alias("images"), F.count_distinct("Condition_Name").alias("conditions"))
    mixed = F.when((F.col("images") > 1) | (F.col("conditions") > 1), F.lit("several images or conditions in one file"))
    files = of_file.join(tables.file_problems(rows), "source_filename", "left").withColumn("error", F.coalesce("error", mixed))
    if from_names:
        said = images.metadata(F.col("source_filename"))
        files = files.withColumn("m", said).select(
            *[c for c in files.columns if c not in ("images", "conditions")],
            *[F.col(f"m.{k}").alias(k) for k in ("diet", "subject_ID")],
            F.coalesce(F.lit(specie), F.col("m.specie")).alias("specie"),
            images.resolve_condition(F.col("m.condition"), F.col("from_file")).alias("r"),
        )
    else:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*_MITO_measurements.txt").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_filename"))
        places = listed.withColumn("_place", F.row_number().over(Window.orderBy("source_filename")))  # a row per file, those of earlier runs too
        files = files.drop("images", "conditions").join(places, "source_filename").withColumn("subject_ID", F.format_string("%03d", "_place")).drop("_place").withColumns(
            {"diet": F.lit(None).cast("string"), "specie": F.lit(specie), "r": images.resolve_condition(F.lit(None).cast("string"), F.col("from_file"))}
        )
    unique = F.concat_ws("_", F.coalesce("specie", F.lit("Unknown")), F.coalesce(F.nullif(F.col("subject_ID"), F.lit("")), F.lit("Unknown")))
    files = files.select("*", F.col("r.condition").alias("condition"), F.col("r.differs").alias("condition_differs"), unique.alias("unique_subject_ID"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")).drop("r", "from_file")
    good = files.where("status = 'ok'").select("source_filename", "specie", "subject_ID", "unique_subject_ID", "condition", "diet")
    if not append and good.isEmpty():
        raise RuntimeError(f"no measurement file of {folder} can be used")
    data.write(rows.join(good, "source_filename"), files, {"features": list(tables.FEATURES), "analysed": analysed_columns(rows.columns)}, replace=not append, expected="n_rows")
    return data.files()


def analysed_columns(columns: Sequence[str]) -> dict[str, bool]:
    """Features of a measurement table and whether analyses use them, by the current list; ValueError if there is none."""
    found = [c for c in columns if c in tables.FEATURES]
    if not found:
        raise ValueError("no measurement feature among the columns")
    return {c: c not in tables.NOT_ANALYSED for c in found}
