import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orospark.operators import catalog, lineage, progress
from orospark.plans import terrain
from orospark.plans.options import PublishOptions, TileOptions
from tests.test_rasters import tiff


def test_manifest_texts(spark):
    rows = [('{"job_id": "a", "status": "completed", "source": {"input_path": "/x/y.tif"}, "publish": {"published": true}}',), ("bad",), ("[1]",), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "t string").select(lineage.read_manifest(F.col("t")).alias("m")).collect()]
    assert got[0].source.input_path == "/x/y.tif" and got[0].publish.published and got[1:] == [None] * 3


def test_changes_merge_with_explicit_nulls(spark):
    rows = [("a", 1, "queued", "x", ["status", "error"]), ("a", 2, "running", None, ["status"]), ("a", 3, None, None, ["error"]), ("b", 4, "queued", None, ["status"])]
    got = {r.job_id: (r.status, r.error, r.updated) for r in lineage.merge_changes(spark.createDataFrame(rows, "job_id string, seq int, status string, error string, sets array<string>"), "job_id", "seq", ["status", "error"]).collect()}
    assert got == {"a": ("running", None, 3), "b": ("queued", None, 4)}


def test_manifest_lifecycle(spark):
    made = lineage.created(spark.createDataFrame([("a", "/d/x.tif", "/o/a", "t0", None), ("b", "/d/y.tif", "/o/b", "t0", None), ("c", "/d/z.tif", "/o/c", "t0", None)], "job_id string, input_path string, output_dir string, at string, request string"))
    ends = spark.createDataFrame([("a", "t1", None, "http://u", "n"), ("b", "t2", "broke", None, None)], "job_id string, at string, error string, terrain_url string, tileset_name string")
    got = {r.job_id: r for r in lineage.job_from_manifest(lineage.finished(made, ends)).collect()}
    assert (got["a"].status, got["a"].published, got["a"].progress.percent, got["a"].terrain_url) == ("completed", True, 100.0, "http://u")
    assert (got["b"].status, got["b"].error, got["b"].progress.message, got["b"].published) == ("failed", "broke", "broke", False)
    assert (got["c"].stage, got["c"].completed_at, got["c"].from_disk) == ("queued", None, True)


def test_job_detail_keeps_the_rest(spark):
    doc = {"job_id": "a", "status": "running", "created_at": "2024-06-01T07:00:00", "request": "{}", "extra": "1"}
    r = lineage.job_detail(spark.createDataFrame([(json.dumps(doc),)], "document string"), F.lit("2024-06-01T07:00:42")).first()
    assert r.metadata == {"extra": "1"} and r.elapsed_seconds == 42.0 and r.error is None


def test_catalogue(spark):
    rows = [("B", 1, True), ("a", 2, True), ("gone", 3, True), ("gone", 4, False), (".hidden", 5, True), ("a", 6, True)]
    got = catalog.listing(catalog.published(spark.createDataFrame(rows, "name string, at int, published boolean"))).collect()
    assert [(r.name, r.at) for r in got] == [("a", 6), ("B", 1)]


def test_metadata_by_priority(spark):
    meta = "name string, format string, format_label string, projection string, crs string, min_zoom int, max_zoom int"
    row = lambda n, f: (n, f, None, None, None, 0, 1)
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    got = catalog.display_metadata(names, spark.createDataFrame([row("a", "1")], meta), spark.createDataFrame([row("a", "2"), row("b", "2")], meta), spark.createDataFrame([row("b", "3"), row("c", "3")], meta))
    assert {r.name: r.format for r in got.collect()} == {"a": "1", "b": "2", "c": "3", "d": None}


def test_weights_and_averages(spark):
    w = spark.createDataFrame([("b", 0, "x", 1.0), ("b", 1, "y", 9.0), ("b", 2, "z", 0.0), ("n", 0, "x", 0.0)], "bucket string, k int, stage string, weight double")
    n = progress.normalise(w, "bucket")
    assert {(r.bucket, r.stage): r.weight for r in n.collect()} == {("b", "x"): 0.1, ("b", "y"): 0.9, ("b", "z"): 0.0, ("n", "x"): 0.0}
    assert [(r.stage, r.start, r.end) for r in progress.stage_ranges(n, "bucket", "k").orderBy("end").collect()] == [("x", 0.0, 10.0), ("y", 10.0, 100.0)]
    d = progress.ratios(spark.createDataFrame([("j", "a", 1.0), ("j", "b", 9.0), ("j", "c", 90.0), ("j", "d", 0.0)], "job string, stage string, s double"), "job", "stage", "s")
    assert {r.stage: r.ratio for r in d.collect()} == {"a": 0.01, "b": 0.09, "c": 0.9}
    s = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.2, 0.8, 0.5])], "k string, i int, v double")
    assert abs(progress.moving_average(s, "k", ["i"], "v", start=0.5, alpha=0.5).first().average - 0.5375) < 1e-12
    assert abs(progress.moving_average(s, "k", ["i"], "v", alpha=0.5).first().average - 0.5) < 1e-12


def test_throttle_lets_forced_updates_through(spark):
    rows = [("j", 1, 0.0, 5.0, False), ("j", 2, 0.1, 5.0, False), ("j", 3, 0.2, 5.0, True), ("j", 4, 0.3, 5.6, False), ("j", 5, 1.4, 5.6, False)]
    e = spark.createDataFrame(rows, "job string, seq int, s double, p double, f boolean")
    assert progress.throttled(e, "job", "s", "p", ["seq"], "f").first().emissions == 4
    assert progress.throttled(e.where("seq < 4"), "job", "s", "p", ["seq"], "f", 60, 50).first().emissions == 2


def test_a_file_becomes_a_tileset(spark, tmp_path):
    space = terrain.Workspace(f"file://{tmp_path}")
    (tmp_path / "d.tif").write_bytes(tiff(np.arange(130 * 130).reshape(130, 130), None, at=(10.0, 50.0, 0.1)))
    job = terrain.run(spark, space, terrain.Request(f"file://{tmp_path}/d.tif", tile=TileOptions(output_format="Terrain"), publish=PublishOptions(True, "hills")))
    assert [(r.name, r.output_format, r.max_zoom) for r in terrain.tilesets(spark, space).collect()] == [("hills", "Terrain", 4)]
    done = terrain.jobs(spark, space).first()
    assert (done.job_id, done.status, done.percent) == (job, "completed", 100.0)
    t = spark.read.parquet(f"{space.job(job)}/tiles")
    assert {r.z: r.n for r in t.groupBy("z").agg(F.sum("n").alias("n")).collect()} == {z: 16900 for z in range(5)}
    deep = t.where("z = 4").select("x", "y").collect()
    assert {r.x for r in deep} == {16, 17, 18} and {r.y for r in deep} == {11, 12}  # 10 to 23 degrees east, 37 to 50 north
    p = terrain.provenance(spark, space).first()
    assert p.source.file_name == "d.tif" and len(p.source.sha256) == 64
    terrain.unpublish(spark, space, "hills")
    assert terrain.tilesets(spark, space).count() == 0
    with pytest.raises(FileNotFoundError):
        terrain.unpublish(spark, space, "hills")
    with pytest.raises(ValueError, match="outside"):
        terrain.run(spark, space, terrain.Request("file:///etc/hosts"))
    (tmp_path / "bad.tif").write_bytes(b"no")
    with pytest.raises(Exception, match="TIFF"):
        terrain.run(spark, space, terrain.Request(f"file://{tmp_path}/bad.tif"), "bad")
    assert {r.job_id: (r.status, r.percent) for r in terrain.jobs(spark, space).collect()}["bad"] == ("failed", 2.0)


def test_mercator_tiles(spark, tmp_path):
    space = terrain.Workspace(f"file://{tmp_path}")
    (tmp_path / "d.tif").write_bytes(tiff(np.arange(40 * 40).reshape(40, 40), None, at=(0.0, 60.0, 1.0)))
    request = terrain.Request(f"file://{tmp_path}/d.tif", terrain.PreprocessOptions(target_crs="EPSG:3857"), TileOptions(profile="mercator", start_zoom=3))
    job = terrain.run(spark, space, request, "m")
    rows = spark.read.parquet(f"{space.job(job)}/tiles").where("z = 3").collect()
    assert sum(r.n for r in rows) == 1600 and {(r.x, r.y) for r in rows} == {(4, 4), (4, 5)}
    layer = json.loads("".join(r.value for r in spark.read.text(f"{space.job(job)}/layer").collect()))
    assert layer["projection"] == "EPSG:3857" and layer["extensions"] == ["octvertexnormals"]


def world(spark, tmp_path, f, **options):
    """Tiles, by address, of a job over the whole world in cells of 1.5 degrees, of height f(lon, lat)."""
    space = terrain.Workspace(f"file://{tmp_path}")
    lon, lat = np.meshgrid(np.arange(240) * 1.5 - 179.25, 89.25 - np.arange(120) * 1.5)
    (tmp_path / "my world.tif").write_bytes(tiff(f(lon, lat), None, at=(-180.0, 90.0, 1.5)))
    job = terrain.run(spark, space, terrain.Request(f"file://{tmp_path}/my world.tif", terrain.PreprocessOptions(build_overviews=False), TileOptions(**options)))
    return space, job, {(r.z, r.x, r.y): r for r in spark.read.parquet(f"{space.job(job)}/tiles").collect()}


def test_heightmaps_of_a_job_show_the_ground(spark, tmp_path):
    space, job, got = world(spark, tmp_path, lambda lon, lat: 1000 + 4 * lon + 2 * lat, output_format="Terrain", start_zoom=2)
    assert len(got) == 2 + 8 + 32
    for (z, x, y), r in got.items():
        assert len(r.body) == 2 * 65 * 65 + 2 and r.body[-2] == (15 if z < 2 else 0) and r.body[-1] == 0
        h = np.frombuffer(r.body[:-2], "<u2").reshape(65, 65) / 5 - 1000
        w = 180 / (1 << z)
        lon, lat = np.meshgrid(x * w - 180 + np.arange(65) * w / 64, (y + 1) * w - 90 - np.arange(65) * w / 64)
        inner = (np.abs(lon) < 170) & (np.abs(lat) < 80)  # samples near the edge have cells on one side only
        assert np.abs(h - (1000 + 4 * lon + 2 * lat))[inner].max() < 4 * 1.5 + 1
    east = lambda z, x, y, k: np.frombuffer(got[z, x, y].body[:-2], "<u2").reshape(65, 65)[:, k]
    assert all((east(2, x, y, 64) == east(2, x + 1, y, 0)).all() for x in range(7) for y in range(4))
    n = terrain.export(spark, space, job, f"file://{tmp_path}/out")
    assert n == 42 and (tmp_path / "out/2/7/3.terrain").read_bytes() == got[2, 7, 3].body
    assert json.loads((tmp_path / "out/layer.json").read_text())["available"][2] == [{"startX": 0, "startY": 0, "endX": 7, "endY": 3}]
    # and a folder of tiles can be published by itself
    assert terrain.publish(spark, space, tiles_dir=f"file://{tmp_path}/out", name="by hand") == "by hand"
    assert terrain.tilesets(spark, space).first().max_zoom == 2
    for bad in (dict(tiles_dir="file:///tmp"), dict(tiles_dir=f"file://{tmp_path}/jobs", name="x"), dict(), dict(job_id="x", tiles_dir="y"), dict(job_id="none")):
        with pytest.raises((ValueError, FileNotFoundError)):
            terrain.publish(spark, space, **bad)


def test_meshes_of_a_job_by_quality_and_method(spark, tmp_path):
    from tests.test_tiles import decode_mesh

    ground = lambda lon, lat: np.where((lon > 10) & (lon < 40) & (lat > 10) & (lat < 40), 500.0, 20.0)
    space, job, got = world(spark, tmp_path, ground, start_zoom=1, mesh_qfactor=9.0, resampling_method="max", vertex_normals=True)
    for r in got.values():
        n = 81  # every eighth of 65 rows and columns
        body, plain = bytes(r.body), bytes(r.body)[: -(5 + 2 * n)]
        assert decode_mesh(plain)[0][4] == (500.0 if (r.z, r.x, r.y) in {(0, 1, 0), (1, 2, 1)} else 20.0) and body[len(plain)] == 1
        assert len(decode_mesh(plain)[1][0]) == n
    manifest = json.loads((tmp_path / f"jobs/{job}/manifest.json").read_text())
    assert (manifest["status"], manifest["source"]["file_name"], json.loads(manifest["request"])["tile"]["mesh_qfactor"]) == ("completed", "my world.tif", 9.0)
    assert list(manifest) == sorted(manifest) and len(manifest["source"]["sha256"]) == 64
    one = terrain.job(spark, space, job).first()
    assert (one.status, one.stage, one.progress.percent, one.from_disk, one.input_path[-12:]) == ("completed", "done", 100.0, False, "my world.tif")
    log, layer = terrain.Workspace(space.root), tmp_path / f"jobs/{job}/layer/layer.json"
    (tmp_path / "logs").rename(tmp_path / "gone")
    one = terrain.job(spark, log, job).first()
    assert (one.status, one.from_disk, one.published) == ("completed", True, False)
    (tmp_path / f"jobs/{job}/manifest.json").unlink()
    assert terrain.job(spark, log, job).first().status == "completed" and terrain.job(spark, log, "none").first() is None
    # a descriptor that is there stays when only one is asked for; one that can't be read doesn't
    kept = json.loads(layer.read_text()) | {"attribution": "kept"}
    again = lambda: terrain.write_layer(spark, spark.read.parquet(f"{space.job(job)}/tiles"), TileOptions(layer_only=True), space.job(job))
    layer.write_text(json.dumps(kept))
    (layer.parent / ".layer.json.crc").unlink(missing_ok=True)
    again()
    assert json.loads(layer.read_text()) == kept
    layer.write_text("no json")
    (layer.parent / ".layer.json.crc").unlink(missing_ok=True)
    again()
    assert len(json.loads(layer.read_text())["available"]) == 2


def test_missing_root_tiles_are_made(spark, tmp_path):
    from tests.test_tiles import decode_mesh

    space = terrain.Workspace(f"file://{tmp_path}")
    (tmp_path / "d.tif").write_bytes(tiff(np.full((20, 20), 70.0), None, at=(10.0, 50.0, 1.0)))
    job = terrain.run(spark, space, terrain.Request(f"file://{tmp_path}/d.tif", tile=TileOptions(vertex_normals=False)))
    got = {(r.z, r.x, r.y): r for r in spark.read.parquet(f"{space.job(job)}/tiles").collect()}
    assert {(0, 0, 0), (0, 1, 0)} <= set(got) and got[0, 0, 0].n == 0 and got[0, 1, 0].n == 400
    header, (u, _, h), _, _ = decode_mesh(bytes(got[0, 0, 0].body))
    assert header[3:5] == (0.0, 0.0) and len(u) == 65 * 65 and not h.any()
    resumed = terrain.run(spark, space, terrain.Request(f"file://{tmp_path}/d.tif", tile=TileOptions(vertex_normals=False, resume=True)), job)
    assert spark.read.parquet(f"{space.job(resumed)}/tiles").count() == len(got)


def test_reference_systems(spark, tmp_path):
    from orospark.sources.geotiff import place, crs, tags

    geographic, web, other = (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326), (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 3857), (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633)
    space = terrain.Workspace(f"file://{tmp_path}")
    k = 6378137 * np.pi / 180
    flat = np.repeat(np.arange(30)[:, None] * 10.0, 20, 1)
    for name, keys, at in (("g", geographic, (10.0, 50.0, 1.0)), ("w", web, (10.0 * k, 50.0 * k, 1.0 * k)), ("o", other, (5e5, 5e6, 30.0)), ("n", None, (5e5, 5e6, 30.0))):
        (tmp_path / f"{name}.tif").write_bytes(tiff(flat, None, at=at, keys=keys))
    assert crs(tags((tmp_path / "w.tif").read_bytes())) == "EPSG:3857" and crs(tags((tmp_path / "g.tif").read_bytes())) == "EPSG:4326"
    for name, match in (("o", "isn't known"), ("n", "aren't degrees")):
        with pytest.raises(Exception, match=match):
            terrain.run(spark, space, terrain.Request(f"file://{tmp_path}/{name}.tif"))
    g = terrain.Grid.of(*place((tmp_path / "w.tif").read_bytes()), "EPSG:3857")
    assert g.mercator and abs(g.west - 10) < 1e-9 and abs(g.dx - 1) < 1e-9
    y = [np.degrees(2 * np.arctan(np.exp(np.radians(50 - (r + 0.5))))) - 90 for r in (0, 29)]
    assert np.allclose(g.ends, y)
    cells = spark.createDataFrame([(r, 0, 10.0 * r) for r in range(30)], "row long, col long, elev double")
    even, to = terrain.reproject(cells, g, "EPSG:4326")
    assert not to.mercator and to.ends == g.ends
    want = lambda r: 10 * (50 - 0.5 - np.degrees(np.log(np.tan(np.radians(45 + (y[0] + (y[1] - y[0]) * r / 29) / 2)))))
    assert all(abs(r.elev - want(r.row)) < 0.05 for r in even.collect())
    with pytest.raises(ValueError, match="EPSG:2154"):
        terrain.reproject(cells, g, "EPSG:2154")


def test_jobs_side_by_side(spark, tmp_path):
    space = terrain.Workspace(f"file://{tmp_path}")
    (tmp_path / "d.tif").write_bytes(tiff(np.full((4, 4), 70.0), None, at=(10.0, 50.0, 1.0)))
    one = lambda p: terrain.Request(p, terrain.PreprocessOptions(build_overviews=False), TileOptions(start_zoom=0))
    got = terrain.run_all(spark, space, [one(f"file://{tmp_path}/d.tif"), one(f"file://{tmp_path}/none.tif"), one(f"file://{tmp_path}/d.tif")])
    assert isinstance(got[1], FileNotFoundError) and {r.job_id for r in terrain.jobs(spark, space).where("status = 'completed'").collect()} == {got[0], got[2]}


def test_calibration_state(spark):
    text = '{"with_publish": {"sample_count": 3, "weights": {"a": 1.0, "b": 3.0}}}'
    df = spark.createDataFrame([(text,), ("bad",), (None,)], "t string").select(progress.calibration_state(F.col("t")).alias("s"))
    got = [r.b for r in df.select(progress.bucket_weights(F.col("s"), True).alias("b")).collect()]
    assert (got[0].weights, got[0].weight_source, got[0].sample_count) == ({"a": 0.25, "b": 0.75}, "historical", 3)
    assert got[1] == got[2] and got[1].weight_source == "default" and abs(got[1].weights["ctb_tile"] - 0.7) < 1e-12
