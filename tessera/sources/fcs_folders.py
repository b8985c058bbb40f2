"""Folders of FCS files to folders of FCS files: events labelled or left out, and a summary by file.

Decisions are a table (source_filename, event_no, kept). Each output file is written by one task,
beside its name first, and then moved, so that a task that is tried again leaves no half file.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow, gates
from . import fcs
from .ingestion import fcs_headers
from .tables import read_workspace

MODES = ("kept_events", "all_events_flagged", "both")
# Endings and label channel of the quality run's files.
KEPT, FLAGGED, LABEL = "FlowAIGoodEvents", "FlowAIFlagged", "FlowAI"
INSIDE, OUTSIDE = 2000.0, 6000.0


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder: a local path, or file:, hdfs:, s3: and gs: addresses."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def _named(name: str, ending: str) -> str:
    return f"{name.rpartition('.')[0] or name}_{ending}.fcs"


def write_labelled(spark: SparkSession, folder: str, out: str, decided: DataFrame, label: str, kept: str, flagged: str, mode: str = "kept_events", overwrite: bool = False, label_kept: bool = False, pattern: str = "*.[fF][cC][sS]") -> DataFrame:
    """Write each file of `folder` that `decided` (source_filename, event_no, kept) covers to `out`; returns rows (source_filename, output_files).

    kept_events: `<stem>_<kept>.fcs` with the events kept (and the label channel, if label_kept);
    all_events_flagged: `<stem>_<flagged>.fcs` with all events and the channel `label`, 2000 kept,
    6000 not; both: the two files. Existing files are refused before anything is written, unless
    `overwrite`. Inputs are never changed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    endings = [e for e, wanted in ((kept, mode != "all_events_flagged"), (flagged, mode != "kept_events")) if wanted]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_filename"), "content")
    if files.select("source_filename").isEmpty():
        raise FileNotFoundError(f"no file {pattern} in {folder}")
    fs, path = _place(out)
    fs.create_dir(path, recursive=True)
    if not overwrite:
        there = {i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(path))}
        if there:
            names = F.array(*[F.concat(F.regexp_replace("source_filename", r"\.[^.]*$", ""), F.lit(f"_{e}.fcs")) for e in endings])
            existing = files.select(F.explode(names).alias("n")).join(spark.createDataFrame([(n,) for n in sorted(there)], "n string"), "n").first()
            if existing:
                raise FileExistsError(f"output files exist (e.g. {existing[0]}); pass overwrite=True to replace them")

    def store(content: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        if content.empty or flags.empty:
            return pd.DataFrame({"source_filename": [(flags if content.empty else content)["source_filename"].iloc[0]], "output_files": [None]})
        name, events = content["source_filename"].iloc[0], fcs.parse(bytes(content["content"].iloc[0]))
        mask = np.zeros(len(events.values), dtype=bool)
        mask[flags.loc[flags["kept"].astype(bool), "event_no"].to_numpy(dtype=int)] = True
        labels, written = {label: np.where(mask, INSIDE, OUTSIDE)}, []
        to, base = _place(out)
        for ending in endings:
            own = ending == kept
            data = fcs.write(events, mask if own else None, labels if label_kept or not own else None)
            part = f"{base}/.{uuid.uuid4().hex}"
            with to.open_output_stream(part) as sink:
                sink.write(data)
            to.move(part, f"{base}/{_named(name, ending)}")
            written.append(_named(name, ending))
        return pd.DataFrame({"source_filename": [name], "output_files": [";".join(written)]})

    flags = decided.select("source_filename", "event_no", F.coalesce("kept", F.lit(False)).alias("kept"))
    done = files.groupBy("source_filename").cogroup(flags.groupBy("source_filename")).applyInPandas(store, "source_filename string, output_files string").where("output_files is not null")
    return spark.createDataFrame(done.collect(), done.schema)  # a row per file; runs the job once


def gate_folder(spark: SparkSession, folder: str, out: str, channels: Sequence[str], inside: Column, ending: str, label: str, mode: str = "kept_events", overwrite: bool = False) -> DataFrame:
    """Write a folder's files gated by `inside`, an expression over `channels`; rows (source_filename, events, kept, pct_kept, output_files)."""
    events = fcs.read(spark, folder, channels).where("event_no is not null")
    decided = events.select("source_filename", "event_no", F.coalesce(inside, F.lit(False)).alias("kept"))
    written = write_labelled(spark, folder, out, decided, label, ending, f"{ending}Flagged", mode, overwrite)
    return gates.gate_summary(decided, F.col("kept")).join(written, "source_filename")


def check_folder(spark: SparkSession, folder: str, out: str, time: str = "Time", mode: str = "kept_events", overwrite: bool = False, **how) -> DataFrame:
    """Quality run over a folder: labelled files in `out`, and a row per file, also as CSV in out/quality_summary.

    Columns: source_filename, status (`ok`, or why the file can't be read), events, kept, the
    percentages removed by each check and by all, resets (how often time goes back), time_increases,
    output_files. All channels but `time` are checked; `how` goes to flow.flow_quality. Files that
    differ in channels or ranges are checked panel by panel.
    """
    heads = fcs_headers(spark, folder).select("source_filename", "channels", "ranges", "error")
    parts: list[DataFrame] = []
    for panel in heads.where("error is null").select("channels", "ranges").distinct().collect():  # a row per panel
        names = [c for c in panel["channels"] if c != time]
        if time not in panel["channels"]:
            continue
        events = fcs.read(spark, folder, panel["channels"]).where("event_no is not null").drop("error")
        same = (F.col("channels") == F.array(*map(F.lit, panel["channels"]))) & (F.col("ranges") == F.array(*[F.lit(float(r)) for r in panel["ranges"]]))
        own = heads.where("error is null").where(same).select("source_filename")
        ranges = {c: None if r != r else r for c, r in zip(panel["channels"], panel["ranges"], strict=True)}
        parts.append(_checked(events.join(own, "source_filename", "left_semi"), time, names, ranges, how))
    if not parts:
        raise FileNotFoundError(f"no FCS file with {time} in {folder} can be read")
    checked = parts[0]
    for part in parts[1:]:
        checked = checked.unionByName(part)
    written = write_labelled(spark, folder, out, checked.select("source_filename", "event_no", F.col("quality_ok").alias("kept")), LABEL, KEPT, FLAGGED, mode, overwrite, label_kept=True)
    resets = flow.time_resets(checked, "source_filename", "_time", "event_no")
    summary = flow.percent_removed(checked, "source_filename").join(resets, "source_filename").withColumn("time_increases", F.col("resets") == 0)
    reason = F.coalesce("error", F.when(~F.array_contains("channels", time), F.lit(f"no channel {time}")), F.lit("ok"))
    listed = heads.select("source_filename", reason.alias("status"))
    made = listed.join(summary, "source_filename", "left").join(written, "source_filename", "left")
    made.coalesce(1).write.mode("overwrite" if overwrite else "error").csv(f"{out.rstrip('/')}/quality_summary", header=True)
    return spark.read.schema(made.schema).csv(f"{out.rstrip('/')}/quality_summary", header=True)


def _checked(events: DataFrame, time: str, names: Sequence[str], ranges: Mapping[str, float | None], how: Mapping) -> DataFrame:
    checked = flow.flow_quality(events, "source_filename", time, "event_no", names, ranges, **how)
    return checked.select("source_filename", "event_no", F.col(time).alias("_time"), "rate_ok", "signal_ok", "range_ok", "quality_ok")


def apply_workspace(spark: SparkSession, workspace: str, folder: str, out: str | None = None, populations: Sequence[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Replay a workspace's gates on a folder's files; rows (sample_file, status, population_path, gate_type, stored, n, parent_n, difference, difference_pct_of_parent, approximate).

    populations: names or paths, all by default; each is taken within its parents. With `out` every
    one is written as `<sample>_<name>.fcs`. Polygons on biexponential axes are approximate. Samples
    without a file have that as status, and nulls.
    """
    gates_ = read_workspace(spark, workspace)
    if gates_.isEmpty():
        raise ValueError(f"no gate in {workspace}")
    wanted = gates_.where(F.col("name").isin(*populations) | F.col("population_path").isin(*populations)) if populations is not None else gates_
    there = fcs_headers(spark, folder).where("error is null").select(F.col("source_filename").alias("sample_file"))
    own = gates_.join(there, "sample_file", "left_semi")
    needs = own.groupBy("sample_file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("needs"))
    counts, seen = None, None
    for panel in needs.select("needs").distinct().collect():  # a row per set of channels
        samples = needs.where(F.col("needs") == F.array(*map(F.lit, panel["needs"]))).select("sample_file")
        events = fcs.read(spark, folder, panel["needs"]).where("event_no is not null").join(samples.withColumnRenamed("sample_file", "source_filename"), "source_filename", "left_semi")
        some = own.join(samples, "sample_file", "left_semi")
        got, lie = gates.replay(events, some), gates.memberships(events, gates.gate_rows(spark, some)).select("source_filename", "event_no", "populations")
        counts, seen = (got, lie) if counts is None else (counts.unionByName(got), seen.unionByName(lie))
    if counts is None:
        raise FileNotFoundError(f"no file of {folder} is a sample of {workspace}")
    biex = F.exists("channels", lambda c: F.coalesce(F.try_element_at("scales", c) == "biex", F.lit(False)))
    listed = wanted.select("sample_file", "population_path", "gate_type", ((F.col("gate_type") == "polygon") & biex).alias("approximate"))
    result = listed.join(counts, ["sample_file", "population_path"], "left").withColumn("status", F.when(F.col("n").isNull(), "no file").otherwise("ok")).withColumn("difference", F.col("n") - F.col("stored"))
    if out is not None:
        for row in wanted.select("name", "population_path").distinct().orderBy("population_path").collect():  # a row per population
            decided = seen.select("source_filename", "event_no", F.array_contains("populations", row["population_path"]).alias("kept"))
            write_labelled(spark, folder, out, decided, row["name"], row["name"], f"{row['name']}Flagged", overwrite=overwrite)
    return result
