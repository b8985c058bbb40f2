"""Runs that die, are repeated or meet; folders of FCS files to folders of FCS files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import flow
from tessera.sources import fcs, fcs_folders, ingestion
from tessera.sources.dataset import Dataset


def some_fcs(names, n, seed=0, **text):
    rng = np.random.default_rng(seed)
    values = rng.uniform(1, 100, (n, len(names)))
    values[:, names.index("Time")] = np.arange(n)
    keys = {"$tot": str(n), "timestep": "0.01"} | {f"$p{k + 1}n": c for k, c in enumerate(names)} | {f"$p{k + 1}r": "262144" for k in range(len(names))} | text
    return fcs.write(fcs.FcsEvents(list(names), [""] * len(names), values, keys))


NAMES = ["FSC-A", "V1-A", "Time"]


def test_a_run_that_dies_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "WORM_001_D10.fcs").write_bytes(some_fcs(NAMES, 5))
    (folder / "WORM_002_D10.fcs").write_bytes(b"broken")
    data = Dataset(spark, out, "events")
    commit = Dataset._commit

    def dies(self, files, run):
        raise OSError("lost")

    monkeypatch.setattr(Dataset, "_commit", dies)
    with pytest.raises(OSError):
        ingestion.ingest_fcs(spark, str(folder), out)
    assert data.runs() == []
    monkeypatch.setattr(Dataset, "_commit", commit)
    ingestion.ingest_fcs(spark, str(folder), out, append=True)
    assert data.rows().count() == 5 and {r["source_filename"]: r["status"] for r in data.files().collect()} == {"WORM_001_D10.fcs": "ok", "WORM_002_D10.fcs": "failed"}
    (folder / "WORM_002_D10.fcs").write_bytes(some_fcs(NAMES, 7))  # mended: tried again
    (folder / "WORM_003_D10.fcs").write_bytes(some_fcs(NAMES, 2))
    monkeypatch.setattr(Dataset, "_commit", dies)
    with pytest.raises(OSError):
        ingestion.ingest_fcs(spark, str(folder), out, append=True)
    assert data.rows().count() == 5
    monkeypatch.setattr(Dataset, "_commit", commit)
    for _ in range(2):  # repeating changes nothing
        files = ingestion.ingest_fcs(spark, str(folder), out, append=True)
        assert {r["source_filename"]: r["status"] for r in files.collect()} == dict.fromkeys(["WORM_001_D10.fcs", "WORM_002_D10.fcs", "WORM_003_D10.fcs"], "ok")
        assert data.rows().count() == 14
    before = data.rows().count()
    assert len(data.vacuum(0)) == 2 and data.rows().count() == before  # the two dead runs


def test_runs_that_meet_replace_and_differ(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="no committed run"):
        data.rows()
    make = lambda *names: spark.createDataFrame([(n, k) for n in names for k in range(3)], "source_filename string, k long")
    files = lambda *names: spark.createDataFrame([(n, "ok", 3) for n in names], "source_filename string, status string, n long")
    data.write(make("a", "b"), files("a", "b"), {"features": ["k"], "species": "Fly", "lab": 1}, expected="n")
    data.write(make("b", "c"), files("b", "c"), {"features": ["k"], "species": "Worm", "lab": 1})  # b came twice
    assert sorted((r["source_filename"], r["count"]) for r in data.rows().groupBy("source_filename").count().collect()) == [("a", 3), ("b", 3), ("c", 3)]
    assert data.metadata() == {"features": ["k"], "species": "Fly", "lab": 1} and data.metadata("same") == {"features": ["k"], "lab": 1}
    with pytest.raises(ValueError, match="features differ"):
        data.write(make("d"), files("d"), {"features": ["z"]})
    with pytest.raises(RuntimeError, match="3 rows of e written, not 9"):
        data.write(make("e"), files("e").withColumn("n", F.lit(9)), expected="n")
    assert data.files().count() == 3
    data.write(make("z"), files("z"), replace=True)
    assert [r["source_filename"] for r in data.files().collect()] == ["z"] and data.rows().count() == 3
    assert len(data.runs()) == 1 and len(data.vacuum(0)) == 1  # what was replaced went at once; the short run goes now
    empty = spark.createDataFrame([], "source_filename string, k long")
    data.write(empty, files("bad").withColumn("status", F.lit("failed")))
    assert data.rows().count() == 3 and data.files().count() == 2


def test_places_of_files_stay_when_others_are_appended(spark, tmp_path):
    from tessera.sources import tables

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def write(name):
        cols = [*tables.META, *tables.FEATURES]
        (folder / name).write_text("\t".join(cols) + "\n" + "\t".join(["e", "Young", "im", "1", *["0.5"] * len(tables.FEATURES)]) + "\n")

    write("a_MITO_measurements.txt")
    write("b_MITO_measurements.txt")
    ingestion.ingest_measurements(spark, str(folder), out, specie="Fly", from_names=False)
    write("c_MITO_measurements.txt")
    files = ingestion.ingest_measurements(spark, str(folder), out, specie="Fly", from_names=False, append=True)
    assert sorted((r["source_filename"][0], r["subject_ID"]) for r in files.collect()) == [("a", "001"), ("b", "002"), ("c", "003")]
    assert Dataset(spark, out).rows().count() == 3 and Dataset(spark, out).metadata()["analysed"]["Mito_FeretX"] is False


def test_gated_folder(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k, n in enumerate((40, 60)):
        (folder / f"t{k}.fcs").write_bytes(some_fcs(NAMES, n, k))
    inside = F.col("V1-A") > 50
    got = {r["source_filename"]: r for r in fcs_folders.gate_folder(spark, str(folder), str(out), ["V1-A"], inside, "P1", "P1_gate", "both").collect()}
    for k, n in enumerate((40, 60)):
        before = fcs.parse((folder / f"t{k}.fcs").read_bytes())
        mask = before.channel("V1-A") > 50
        kept, flagged = fcs.parse((out / f"t{k}_P1.fcs").read_bytes()), fcs.parse((out / f"t{k}_P1Flagged.fcs").read_bytes())
        assert (kept.values == before.values[mask]).all() and kept.names == NAMES
        assert flagged.channel("P1_gate").tolist() == np.where(mask, 2000.0, 6000.0).tolist() and (flagged.values[:, :3] == before.values).all()
        assert (got[f"t{k}.fcs"]["events"], got[f"t{k}.fcs"]["kept"], got[f"t{k}.fcs"]["output_files"]) == (n, mask.sum(), f"t{k}_P1.fcs;t{k}_P1Flagged.fcs")
    with pytest.raises(FileExistsError):
        fcs_folders.gate_folder(spark, str(folder), str(out), ["V1-A"], inside, "P1", "P1_gate")
    assert fcs_folders.gate_folder(spark, str(folder), str(out), ["V1-A"], inside, "P1", "P1_gate", overwrite=True).count() == 2
    with pytest.raises(ValueError):
        fcs_folders.gate_folder(spark, str(folder), str(out), ["V1-A"], inside, "P1", "P1_gate", mode="none")


def test_checked_folder(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    rng = np.random.default_rng(5)
    values = np.column_stack([rng.uniform(100, 900, 3000), rng.normal(500, 30, 3000), np.sort(rng.uniform(0, 6000, 3000))])
    values[1500:1700, 1] = 262143  # beyond the range
    keys = {"$tot": "3000", "timestep": "0.01"} | {f"$p{k + 1}n": c for k, c in enumerate(NAMES)} | {f"$p{k + 1}r": "262144" for k in range(3)}
    (folder / "good.fcs").write_bytes(fcs.write(fcs.FcsEvents(NAMES, [""] * 3, values, keys)))
    (folder / "bad.fcs").write_bytes(b"FCS")
    (folder / "untimed.fcs").write_bytes(fcs.write(fcs.FcsEvents(["V1-A"], [""], values[:5, 1:2], {"$p1n": "V1-A", "$p1r": "262144"})))
    got = {r["source_filename"]: r for r in fcs_folders.check_folder(spark, str(folder), str(out), mode="both", checks=("dynamic_range", "flow_rate")).collect()}
    assert got["bad.fcs"]["status"] != "ok" and got["untimed.fcs"]["status"] == "no channel Time"
    assert (got["good.fcs"]["status"], got["good.fcs"]["events"], got["good.fcs"]["time_increases"], got["good.fcs"]["resets"]) == ("ok", 3000, True, 0)
    events = fcs.read(spark, str(folder), NAMES, "good.fcs").where("event_no is not null")
    want = {r["event_no"] for r in flow.flow_quality(events, "source_filename", "Time", "event_no", NAMES[:2], dict.fromkeys(NAMES, 262144.0), ("dynamic_range", "flow_rate")).where("quality_ok").collect()}
    kept = fcs.parse((out / "good_FlowAIGoodEvents.fcs").read_bytes())
    assert len(kept.values) == len(want) == got["good.fcs"]["kept"] <= 2800 and set(kept.channel("FlowAI")) == {2000.0}
    flags = fcs.parse((out / "good_FlowAIFlagged.fcs").read_bytes()).channel("FlowAI")
    assert set(np.flatnonzero(flags == 2000.0).tolist()) == want


WORKSPACE = """<Workspace xmlns:g="g" xmlns:d="d" xmlns:t="t"><SampleList>{samples}</SampleList></Workspace>"""
SAMPLE = """<Sample><DataSet uri="file:/x/{name}.fcs"/><Transformations><t:log><d:parameter d:name="Comp-V1-A"/></t:log><t:biex><d:parameter d:name="B1-A"/></t:biex><t:linear><d:parameter d:name="FSC-A"/></t:linear></Transformations>
<SampleNode name="t" count="{n}"><Subpopulations><Population name="P1" count="{p1}"><Gate><g:RectangleGate><g:dimension g:min="20"><d:fcs-dimension d:name="FSC-A"/></g:dimension>
<g:dimension g:max="{high}"><d:fcs-dimension d:name="Comp-V1-A"/></g:dimension></g:RectangleGate></Gate><Subpopulations><Population name="DR+" count="7"><Gate><g:PolygonGate>
<g:dimension><d:fcs-dimension d:name="Comp-V1-A"/></g:dimension><g:dimension><d:fcs-dimension d:name="B1-A"/></g:dimension>{corners}</g:PolygonGate></Gate></Population></Subpopulations></Population></Subpopulations></SampleNode></Sample>"""
CORNERS = [(2.0, -300.0), (90.0, -300.0), (60.0, 400.0), (2.0, 200.0)]


def write_workspace(path, samples):
    corners = "".join(f'<g:vertex><g:coordinate d:value="{a}"/><g:coordinate d:value="{b}"/></g:vertex>' for a, b in CORNERS)
    path.write_text(WORKSPACE.format(samples="".join(SAMPLE.format(name=name, n=9, p1=p1, high=high, corners=corners) for name, p1, high in samples)))


def in_drawn(x, y):
    """Even-odd rule on the drawn axes."""
    shown = lambda a, b: (np.log10(np.maximum(a, 1.0)), np.arcsinh(b / 250.0))
    x, y = shown(x, y)
    corners = [shown(np.float64(a), np.float64(b)) for a, b in CORNERS]
    inside = np.zeros(len(x), dtype=bool)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))
    return inside


def test_workspace_on_a_folder(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    names = ["FSC-A", "V1-A", "B1-A"]
    rng = np.random.default_rng(6)
    want = {}
    for k, high in enumerate((70.0, 95.0)):
        values = np.column_stack([rng.uniform(0, 100, 200), rng.uniform(-5, 100, 200), rng.normal(0, 300, 200)]).astype("<f4").astype(float)
        (folder / f"s{k}.fcs").write_bytes(fcs.write(fcs.FcsEvents(names, [""] * 3, values, {f"$p{i + 1}r": "262144" for i in range(3)})))
        p1 = (values[:, 0] >= 20) & (np.maximum(values[:, 1], 1.0) < high)
        want[f"s{k}.fcs"] = (values, p1, p1 & in_drawn(values[:, 1], values[:, 2]))
    write_workspace(tmp_path / "w.wsp", [("s0", int(want["s0.fcs"][1].sum()), 70), ("s1", 5, 95), ("s2", 1, 95)])
    got = {(r["sample_file"], r["population_path"]): r for r in fcs_folders.apply_workspace(spark, str(tmp_path / "w.wsp"), str(folder), str(out)).collect()}
    assert len(got) == 6 and got["s2.fcs", "P1"]["status"] == "no file" and got["s0.fcs", "P1"]["difference"] == 0
    for name, (values, p1, dr) in want.items():
        a, b = got[name, "P1"], got[name, "P1/DR+"]
        assert (a["n"], a["parent_n"], b["n"], b["parent_n"], b["stored"]) == (p1.sum(), 200, dr.sum(), p1.sum(), 7) and 0 < dr.sum() < p1.sum()
        assert not a["approximate"] and b["approximate"]
        for ending, mask in (("P1", p1), ("DR+", dr)):
            assert (fcs.parse((out / f"{name[:-4]}_{ending}.fcs").read_bytes()).values == values[mask]).all()
    only = fcs_folders.apply_workspace(spark, str(tmp_path / "w.wsp"), str(folder), populations=["DR+"])
    assert {r["population_path"] for r in only.collect()} == {"P1/DR+"}


def test_plans_do_not_grow_with_the_samples(spark):
    from tessera.operators import gates

    def made(samples):
        return [
            {"sample_file": f"s{k}", "population_path": path, "parent_path": parent, "gate_type": "rectangle", "channels": ["x"], "bounds": [[low + k, 1e9]], "vertices": [], "count": 1}
            for k in range(samples) for path, parent, low in (("P1", "root", 0.0), ("P1/a", "P1", 5.0))
        ]

    events = spark.range(500 * 20).select(F.concat(F.lit("s"), (F.col("id") % 500).cast("string")).alias("source_filename"), ((F.col("id") % 500) + F.floor(F.col("id") / 500)).cast("double").alias("x"))
    size = lambda n: len(gates.replay(events, made(n))._jdf.queryExecution().optimizedPlan().toString())
    assert size(500) < 1.2 * size(2)
    got = gates.replay(events, made(500)).groupBy("population_path").agg(F.sum("n"), F.sum("parent_n")).collect()
    assert sorted(map(tuple, got)) == [("P1", 10000, 10000), ("P1/a", 7500, 10000)]
    with pytest.raises(NotImplementedError):
        gates.replay(events, [made(1)[0] | {"gate_type": "ellipsoid"}])
    with pytest.raises(ValueError, match="missing"):
        gates.replay(events.drop("x"), made(1))
