"""Rasters, noise, result logs, plans, units and streams, from files that the tests write."""

import gzip
import json
import struct

import numpy as np
import pytest
from contourflow.operators import stats
from contourflow.plans import tables, units
from contourflow.plans.units import NotPossible
from contourflow.sources import noise, rasters, results
from contourflow.streaming import status
from pyspark.sql import functions as F


def tiff(path, z, order="<", kind="f4", per=4, rotate=0, nodata=None, **tags):
    """A striped file: data, values out of line, then the directory."""
    z = np.asarray(z)
    n_rows, n_cols = z.shape
    strips = [z[k : k + per].astype(order + kind).tobytes() for k in range(0, n_rows, per)]
    out, offsets = bytearray(struct.pack(order.replace("<", "<2sHI").replace(">", ">2sHI"), b"II" if order == "<" else b"MM", tags.pop("magic", 42), 0)), [0] * len(strips)
    for k in np.roll(np.arange(len(strips)), rotate):
        offsets[k] = len(out)
        out += strips[k]
    entries = {256: (4, [n_cols]), 257: (4, [n_rows]), 258: (3, [8 * int(kind[1])]), 259: (3, [tags.get("compression", 1)]), 273: (4, offsets), 277: (3, [tags.get("samples", 1)]), 278: (4, [per]), 279: (4, [len(s) + tags.get("pad", 0) for s in strips]), 284: (3, [1]), 339: (3, [{"u": 1, "i": 2, "f": 3}[kind[0]]]), 33550: (12, [10.0, tags.get("high", 10.0), 0.0]), 33922: (12, [0, 0, 0, 500000.0, 5000000.0, 0.0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 31700])}
    if "tiled" in tags:
        entries[322] = (4, [16])
    if nodata is not None:
        entries[42113] = (2, str(nodata).encode() + b"\0")
    rows = []
    for tag, (code, values) in sorted(entries.items()):
        raw = values if code == 2 else struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[code] }", *values)
        if len(raw) > 4:
            at = len(out)
            out += raw
            raw = struct.pack(order + "I", at)
        rows.append(struct.pack(order + "HHI", tag, code, len(values)) + raw.ljust(4, b"\0"))
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(rows)) + b"".join(rows) + struct.pack(order + "I", 0)
    path.write_bytes(out)
    return f"file://{path}"


RAMP = (100 + 10 * np.arange(12)[:, None] + 0.5 * np.arange(15)[None, :]).astype("f4")


@pytest.mark.parametrize("order, kind, per, rotate", [("<", "f4", 4, 0), (">", "f4", 5, 1), ("<", "i2", 1, 3), (">", "f8", 12, 0), ("<", "u4", 7, 1)])
def test_geotiff_windows(spark, tmp_path, order, kind, per, rotate):
    rasters.register(spark)
    z = RAMP.astype(kind).astype(float)
    path = tiff(tmp_path / "a.tif", RAMP, order, kind, per, rotate)
    got = {(r["i"], r["j"]): r["z"] for r in spark.read.format("geotiff").option("row0", 3).option("col0", 2).option("nRows", 6).option("nCols", 9).load(path).collect()}
    assert got == {(i, j): z[i + 3, j + 2] for i in range(6) for j in range(9)}
    step = {(r["i"], r["j"]): r["z"] for r in spark.read.format("geotiff").option("stride", 3).load(path).collect()}
    assert step == {(i, j): z[3 * i, 3 * j] for i in range(4) for j in range(5)}
    head = rasters.read_header(path)
    assert head.transform == (500000.0, 5000000.0, 10.0, 10.0) and head.epsg == 31700


def test_geotiff_voids(spark, tmp_path):
    rasters.register(spark)
    z = RAMP.copy()
    z[2:4, 5] = -9999
    rows = spark.read.format("geotiff").load(tiff(tmp_path / "v.tif", z, nodata=-9999)).filter("NOT valid").collect()
    assert {(r["i"], r["j"], r["z"]) for r in rows} == {(2, 5, None), (3, 5, None)}


@pytest.mark.parametrize("bad, why", [({"magic": 43}, "BigTIFF"), ({"magic": 7}, "magic"), ({"compression": 5}, "compression"), ({"samples": 3}, "samples"), ({"tiled": 1}, "tiled"), ({"pad": 4}, "padded"), ({"high": 12.0}, "square")])
def test_geotiff_refusals(tmp_path, bad, why):
    with pytest.raises(rasters.RasterError, match=why):
        rasters.read_header(tiff(tmp_path / "b.tif", RAMP, **bad))
    (tmp_path / "c.tif").write_bytes(b"hello, no raster")
    with pytest.raises(rasters.RasterError, match="not a TIFF"):
        rasters.read_header(f"file://{tmp_path}/c.tif")


def test_tile(spark, tmp_path):
    rasters.register(spark)
    z = np.zeros((1201, 1201), dtype=">i2")
    z[0], z[5, 6] = 7, rasters.VOID
    (tmp_path / "N45E024.hgt").write_bytes(z.tobytes())
    df = spark.read.format("hgt").option("nRows", 10).option("nCols", 20).load(f"file://{tmp_path}/N45E024.hgt")
    assert df.count() == 200 and df.filter("NOT valid").select("i", "j").first() == (5, 6) and df.filter("i = 0").agg(F.min("z")).first()[0] == 7
    assert rasters.tile_corner("N45E024") == (45, 24) and rasters.tile_corner("s03w060") == (-3, -60)
    for bad in ("X45E024", "N4E024"):
        with pytest.raises(rasters.RasterError):
            rasters.tile_corner(bad)
    with pytest.raises(rasters.RasterError):
        rasters.tile_samples(1000)


def plain_noise(shape, g):
    d, out = [s // (n - 1) for s, n in zip(shape, g.shape, strict=False)], np.zeros(shape)
    fade = lambda t: t**3 * (6 * t * t - 15 * t + 10)
    for i, j in np.ndindex(*shape):
        (ci, fi), (cj, fj) = ((p // n, p % n / n) for p, n in zip((i, j), d, strict=True))
        dot = {(a, b): g[ci + a, cj + b] @ (fi - a, fj - b) for a in (0, 1) for b in (0, 1)}
        low, high = ((1 - fade(fi)) * dot[0, b] + fade(fi) * dot[1, b] for b in (0, 1))
        out[i, j] = np.sqrt(2) * ((1 - fade(fj)) * low + fade(fj) * high)
    return out


def test_noise_equals_its_formula(spark):
    g = noise.lattice_2d((2, 3), np.random.RandomState(5))
    got = {(r["p0"], r["p1"]): r["noise"] for r in noise.noise(spark, (8, 9), g).collect()}
    expect = plain_noise((8, 9), g)
    assert all(abs(got[k] - expect[k]) < 1e-12 for k in np.ndindex(8, 9))
    with pytest.raises(ValueError):
        noise.noise(spark, (7, 9), g)
    rows = noise.terrain(spark, "t", 24, 4, 100.0, 160.0, 3).agg(F.min("z"), F.max("z"), F.count("*")).first()
    assert 40 <= rows[0] < rows[1] <= 160 and rows[2] == 576
    assert noise.fractal(spark, (8, 8), (2, 2), 2, 0.5, 2, 1).count() == 64
    assert noise.noise(spark, (4, 4, 4), noise.lattice_3d((2, 2, 2), np.random.RandomState(1))).count() == 64
    wrapped = noise.lattice_2d((2, 2), np.random.RandomState(1), (True, True))
    assert (wrapped[0] == wrapped[-1]).all() and (wrapped[:, 0] == wrapped[:, -1]).all()


def test_result_files_round_trip(spark, tmp_path):
    inf = float("inf")
    df = spark.createDataFrame([(1, 1.5, True, "a", [3, 4]), (2, inf, None, None, None), (3, -inf, False, "x,y", []), (4, float("nan"), True, "", [5])], "k int, x double, ok boolean, t string, xs array<int>")
    results.rendered(df).coalesce(1).write.option("header", True).option("compression", "gzip").csv(f"file://{tmp_path}/r.csv")
    got = {r["k"]: r for r in results.read_csv(spark, f"file://{tmp_path}/r.csv", "k int, x double, ok boolean, t string, xs string").collect()}
    assert got[1]["x"] == 1.5 and got[2]["x"] == inf and got[3]["x"] == -inf and got[4]["x"] != got[4]["x"] and got[2]["ok"] is None and got[1]["xs"] == "3x4"
    lines = [json.loads(r["value"]) for r in results.strict_json(df).collect()]
    assert lines[1]["x"] == "inf" and lines[3]["x"] == "nan" and list(lines[0]) == sorted(lines[0]) and lines[0]["xs"] == [3, 4]
    with gzip.open(tmp_path / "log.jsonl.gz", "wt") as f:
        f.write('{"unit_id": 1, "status": "done"}\n{"unit_id": 2, "sta')
    assert results.read_jsonl(spark, f"file://{tmp_path}/log.jsonl.gz", "unit_id int, status string").filter("unit_id IS NOT NULL").count() == 1
    assert {r["name"] for r in results.result_files(spark, f"file://{tmp_path}").collect()} >= {"log.jsonl"}
    assert results.slim(df, ["x", "k"]).columns == ["k", "x"]
    assert results.catalogue(spark, {"there": f"file://{tmp_path}/none"}) == {"there": False}


def test_plans_and_units(spark):
    plan = '[[lane]]\nname = "a"\nworkers = 2\nexperiments = ["X1"]\n[[lane]]\nname = "b"\nworkers = 1\nexperiments = ["X2"]\n'
    assert results.load_plan(spark, plan, {"X1", "X2"}).count() == 2
    for bad in (plan.replace("X2", "X1"), plan.replace("workers = 2", "workers = 0"), plan.replace("X2", "X9"), ""):
        with pytest.raises(ValueError):
            results.load_plan(spark, bad, {"X1", "X2"})
    assert results.config_rows(spark, grid=[10, 12], scale=[5, 6]).count() == 2
    assert units.units(spark, "X1", "standard").count() == 10 * 3 * 3 * 2 * 3
    quick = units.units(spark, "X1", "quick")
    with pytest.raises(ValueError):
        units.lane(quick, {"size": {"most": 3}})

    def worker(unit):
        if unit["seed"] == 1:
            raise NotPossible("too large")
        return [{"cost": 1.0, "arm": "full"}, {"cost": 2.0, "arm": "ring"}]

    rows, log = units.run(quick, None, worker, "cost double, arm string")
    assert rows.count() == 2 and {r["status"] for r in log.collect()} == {"done", "not_possible"}
    done = spark.createDataFrame([(quick.first()["unit_id"], 1, "done", 1)], "unit_id string, run_id long, status string, at long")
    assert stats.not_done(quick, done).count() == quick.count() - 1
    assert units.snapshot(done).first()["n_units"] == 1
    with pytest.raises(units.NotPossible):
        units.require_memory(10**9, 10**9)
    history = spark.createDataFrame([("X1", "done", 100, 2.0)], "experiment string, status string, cells long, wall_s double")
    assert units.with_estimates(quick, history).first()["estimate_s"] == pytest.approx(288.0)


def test_folder_lock(tmp_path):
    with units.FolderLock(str(tmp_path)):
        with pytest.raises(units.Locked), units.FolderLock(str(tmp_path)):
            pass
    with units.FolderLock(str(tmp_path)):
        pass


def test_markdown_and_markers(spark):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    assert tables.markdown(df, "t").splitlines()[2:] == ["| k | n |", "| --- | --- |", "| a | 1 |"]
    with pytest.raises(ValueError):
        tables.markdown(spark.range(5), most_rows=3)
    text, missing = tables.fill_markers("{{fact:n}} and {{fact:m}}", {"n": lambda rows: str(rows.count())}, df)
    assert text == "1 and [missing: m]" and missing == ["m"]
    assert tables.numbered("{{fig:b}} {{fig:a}} {{fig:b}}", "fig") == ("1 2 1", ["b", "a"])


def test_streams_equal_their_batch(spark, tmp_path):
    schema = "unit_id long, run_id long, status string, at timestamp"
    rows = [(u, k, "done" if k % 3 else "failed", f"2024-01-01 00:{k % 60:02d}:00") for k in range(90) for u in (k % 7,)]
    batch = spark.createDataFrame(rows, "unit_id long, run_id long, status string, at string").withColumn("at", F.to_timestamp("at"))
    batch.repartition(4).write.json(f"file://{tmp_path}/log")
    log = status.read_json_log(spark, f"file://{tmp_path}/log", schema, 1)
    status.into_table(status.latest(log), f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    pick = lambda df: {tuple(r) for r in df.select("unit_id", "run_id", "status").collect()}
    assert pick(spark.read.parquet(f"file://{tmp_path}/t")) == pick(stats.latest_status(batch))
    status.into_table(status.progress(log, "10 minutes", "0 seconds"), f"file://{tmp_path}/p", f"file://{tmp_path}/pc", "append").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/p").agg(F.sum("n")).first()[0] <= 90


def test_stalled_units_are_told(spark, tmp_path):
    schema = "unit_id long, run_id long, status string, at timestamp"
    early = [(1, 1, "beat", "2024-01-01 00:00:00"), (2, 2, "beat", "2024-01-01 00:00:00")]
    late = [(2, 3, "beat", "2024-01-01 01:00:00")]
    for k, rows in enumerate((early, late, [(2, 4, "beat", "2024-01-01 01:00:10")])):
        spark.createDataFrame(rows, "unit_id long, run_id long, status string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.json(f"file://{tmp_path}/log/{k}")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"file://{tmp_path}/log")
    status.into_table(status.stalled(log), f"file://{tmp_path}/s", f"file://{tmp_path}/sc", "append").awaitTermination()
    assert {r["unit_id"] for r in spark.read.parquet(f"file://{tmp_path}/s").collect()} == {1}
