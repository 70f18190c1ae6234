import json
import struct

import pytest
from pyspark.sql import functions as F

from orospark.operators import tiles
from orospark.sources.files import exists, fingerprints, is_inside, json_texts, list_folder, scan_tiles
from orospark.sources.sinks import write_document


def tree(root, names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\0")


def test_extents_of_a_tile_tree(spark, tmp_path):
    tree(tmp_path / "t", ["0/0/0.terrain", "0/1/0.terrain", "1/2/4.terrain", "1/2/x.terrain", "1/b/4.terrain", "1/3/5.txt", "²/0/0.terrain"])
    found = tiles.extents(scan_tiles(spark, f"file://{tmp_path}/t")).orderBy("z").collect()
    assert [tuple(r) for r in found] == [(0, 0, 0, 1, 0), (1, 2, 4, 2, 4)]
    assert scan_tiles(spark, f"file://{tmp_path}/none").count() == 0


def test_available_has_gaps_and_zoom_range(spark):
    boxes = spark.createDataFrame([(0, 0, 0, 1, 0), (2, 4, 8, 5, 9)], "z int, startX long, startY long, endX long, endY long")
    a = tiles.available(boxes)
    assert [len(x) for x in a.first().available] == [1, 0, 1]
    assert tuple(a.select(tiles.zoom_range(F.col("available")).alias("r")).first().r) == (0, 2)
    empty = spark.sql("select cast(array() as array<array<struct<startX:int>>>) as a")
    assert tuple(empty.select(tiles.zoom_range(F.col("a")).alias("r")).first().r) == (None, None)


def test_descriptor_and_keeping_one(spark):
    boxes = spark.createDataFrame([(0, 0, 0, 1, 0)], "z int, startX long, startY long, endX long, endY long")
    text = tiles.descriptor(boxes, "Terrain", "mercator").first().layer_json
    d = json.loads(text)
    assert d["format"] == "heightmap-1.0" and d["projection"] == "EPSG:3857" and d["available"] == [[{"startX": 0, "startY": 0, "endX": 1, "endY": 0}]]
    keep = lambda x: spark.range(1).select(tiles.keep_or_generate(F.lit(x).cast("string"), F.lit("new")).alias("x")).first().x
    assert keep(text) == text and [keep(x) for x in (None, "bad", "[]", '{"available": []}')] == ["new"] * 4


def test_coverage_of_other_projections(spark):
    rows = [("EPSG:3857", [1.0, 2.0, 3.0, 4.0]), ("EPSG:3857", None), ("EPSG:4326", None)]
    df = spark.createDataFrame(rows, "projection string, bounds array<double>").withColumn("available", F.expr("array(array(struct(1 as startX, 2 as startY, 3 as endX, 4 as endY)), cast(array() as array<struct<startX:int,startY:int,endX:int,endY:int>>))"))
    got = tiles.coverage(df).collect()
    assert got[0].declared == [1.0, 2.0, 3.0, 4.0] and got[0].cover is None and got[1].declared is None and got[2].cover.z == 0


@pytest.mark.parametrize(("profile", "want"), [("geodetic", (2, 1)), ("mercator", (1, 1))])
def test_tile_of_a_place(spark, profile, want):
    x, y = tiles.tile_xy(F.lit(10.0), F.lit(20.0), F.lit(1), profile)
    assert tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first()) == want
    x, y = tiles.tile_xy(F.lit(180.0), F.lit(90.0), F.lit(1), profile)
    top = (3, 1) if profile == "geodetic" else (1, 1)
    assert tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first()) == top


def test_pyramid_keeps_rows_of_several_zooms(spark):
    rows = [(2, 5, 3, 10), (2, 4, 3, None), (1, 0, 0, 7)]
    got = tiles.pyramid(spark.createDataFrame(rows, "z int, x long, y long, elev long")).collect()
    assert {(r.z, r.x, r.y): (r.n, r.total, r.least, r.most) for r in got} == {(2, 5, 3): (1, 10, 10, 10), (2, 4, 3): (0, None, None, None), (1, 2, 1): (1, 10, 10, 10), (1, 0, 0): (1, 7, 7, 7), (0, 1, 0): (1, 10, 10, 10), (0, 0, 0): (1, 7, 7, 7)}
    assert tiles.pyramid(spark.createDataFrame([], "z int, x long, y long, elev long")).count() == 0


def test_workspace(spark, tmp_path):
    tree(tmp_path / "w", ["b.TIF", "a.dem", "note.txt", ".tif", "jobs/x", "Folder/c.img", "Folder/jobs/y"])
    (tmp_path / "w/odd.tif").mkdir()
    root = f"file://{tmp_path}/w"
    assert [(r.name, r.entry_type) for r in list_folder(spark, root).collect()] == [("Folder", "directory"), ("odd.tif", "directory"), ("a.dem", "file"), ("b.TIF", "file")]
    assert [(r.relative_path, r.selectable) for r in list_folder(spark, root, "Folder").collect()] == [("Folder/jobs", False), ("Folder/c.img", True)]
    for bad in ("..", "../other", "Folder/../../x"):
        with pytest.raises(ValueError, match="outside"):
            list_folder(spark, root, bad)
    with pytest.raises(FileNotFoundError):
        list_folder(spark, root, "none")
    with pytest.raises(ValueError, match="file"):
        list_folder(spark, root, "a.dem")
    assert exists(spark, root)


def test_paths_inside_a_workspace(spark, tmp_path):
    (tmp_path / "my work").mkdir()
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "my work/a b.tif").write_bytes(b"x")
    (tmp_path / "my work/out").symlink_to(tmp_path / "elsewhere")
    (tmp_path / "my work/in").symlink_to(tmp_path / "my work")
    root = f"file://{tmp_path}/my work"
    inside = lambda p: is_inside(spark, p, root)
    assert inside(root) and inside(root + "/a b.tif") and inside(f"{tmp_path}/my work/x/../y%20z") and inside(root + "/in/a b.tif")
    assert not inside(root + "/out/x") and not inside(root + "/../elsewhere") and not inside(root + "er") and not inside("file:///")
    assert [r.name for r in list_folder(spark, root).where("entry_type = 'file'").collect()] == ["a b.tif"]
    r = fingerprints(spark, root + "/a b.tif").first()
    assert (r.file_name, r.size_bytes) == ("a b.tif", 1)


def test_documents_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/d/doc.json"
    write_document(spark, path, {"b": "é", "a": [1]})
    write_document(spark, path, '{"z": null, "a": 2}')
    assert (tmp_path / "d/doc.json").read_text() == '{\n  "a": 2,\n  "z": null\n}'
    assert [f.name for f in (tmp_path / "d").iterdir() if not f.name.endswith(".crc")] == ["doc.json"]
    assert json.loads(json_texts(spark, path).first().text) == {"a": 2, "z": None} and json_texts(spark, f"file://{tmp_path}/d/x*.json").count() == 0


def test_fingerprints(spark, tmp_path):
    tree(tmp_path, ["a.tif"])
    r = fingerprints(spark, f"file://{tmp_path}/a.tif").first()
    assert (r.file_name, r.size_bytes, r.sha256) == ("a.tif", 1, "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d")


def test_heightmap_bodies(spark):
    cells = spark.createDataFrame([(r, c, 10 * r + c) for r in range(3) for c in range(3)], "row long, col long, elev long")
    t = tiles.heightmap_bytes(tiles.heightmaps(cells, 3, 5)).where("x = 0 and y = 0").first()
    want = [(10 * r + c + 1000) * 5 for r in range(3) for c in range(3)]
    assert t.samples == want and t.body == b"".join(v.to_bytes(2, "little") for v in want) + b"\x0f\0"


@pytest.mark.parametrize("size", [33, 129])
def test_heightmaps_of_a_gappy_grid(spark, size):
    import numpy as np

    n, step = 140, size - 1
    grid = np.add.outer(np.arange(n) * 3, np.arange(n)) % 97
    cells = spark.range(n * n).select((F.col("id") / n).cast("long").alias("row"), (F.col("id") % n).alias("col")).withColumn("elev", F.when((F.col("row") + F.col("col")) % 7 != 0, (F.col("row") * 3 + F.col("col")) % 97))
    for up in (False, True):
        got = {(r.x, r.y): r for r in tiles.heightmaps(cells, size, 3, missing=7, south_up=up).collect()}
        assert set(got) == {(x, y) for x in range(-(-n // step)) for y in range(-(-n // step))}
        for (x, y), r in got.items():
            want = np.full((size, size), 7)
            for j in range(size):
                for i in range(size):
                    a, b = y * step + j, x * step + i
                    if a < n and b < n and (a + b) % 7:
                        want[size - 1 - j if up else j, i] = (grid[a, b] + 1000) * 5
            assert r.samples == want.ravel().tolist() and r.filled == (want != 7).sum()


def test_children_of_tiles(spark):
    t = spark.createDataFrame([(4, 6), (5, 6), (4, 7), (1, 1)], "x long, y long")
    assert {(r.x, r.y): r.children for r in tiles.children(t).collect()} == {(2, 3): 7, (0, 0): 8}


def test_meshes_share_their_edges(spark):
    cells = spark.createDataFrame([(r, c, r * c) for r in range(33) for c in range(33)], "row long, col long, elev long")
    got = tiles.mesh_vertices(cells, 17).where("tile_x < 2 and tile_y < 2").collect()  # the last row and column also begin further tiles
    assert len(got) == 4 * 289 and max(r.u for r in got) == max(r.v for r in got) == 32767
    edge = lambda x, u: {(r.tile_y, r.v) for r in got if r.tile_x == x and r.u == u}
    assert edge(0, 32767) == edge(1, 0) and len(edge(0, 32767)) == 34


def test_pyramid_extents_are_those_of_the_pyramid(spark):
    rows = [(9, 700, 300, 1), (9, 701, 290, 2), (4, 3, 9, 3), (0, 1, 0, 4), (11, 4000, 17, None)]
    t = spark.createDataFrame(rows, "z int, x long, y long, elev long")
    for end in (0, 3, 9):
        slow = {tuple(r) for r in tiles.extents(tiles.pyramid(t.where(F.col("z") >= end), end)).collect()}
        assert {tuple(r) for r in tiles.pyramid_extents(t.where(F.col("z") >= end), end).collect()} == slow
        totals = tiles.pyramid(t.where(F.col("z") >= end), end).groupBy("z").agg(F.sum("n").alias("n")).collect()
        assert {r.z: r.n for r in totals} == {z: sum(r[0] >= z and r[3] is not None for r in rows if r[0] >= end) for z in range(end, 12)}


def decode_mesh(body):
    import numpy as np

    n = struct.unpack_from("<I", body, 88)[0]
    at, out = 92, []
    for _ in range(3):
        z = np.frombuffer(body, "<u2", n, at).astype(int)
        out.append(np.cumsum((z >> 1) ^ -(z & 1)))
        at += 2 * n
    t = struct.unpack_from("<I", body, at)[0]
    codes, high, indices = np.frombuffer(body, "<u2", 3 * t, at + 4), 0, []
    for c in codes.tolist():
        indices.append(high - c)
        high += c == 0
    at += 4 + 6 * t
    edges = []
    for _ in range(4):
        k = struct.unpack_from("<I", body, at)[0]
        edges.append(np.frombuffer(body, "<u2", k, at + 4).tolist())
        at += 4 + 2 * k
    assert at == len(body)
    return struct.unpack_from("<3d2f4d3d", body), out, np.array(indices).reshape(-1, 3), edges


def test_quantised_meshes(spark):
    import numpy as np

    from orospark.operators.encode import ecef, mesh_bytes, quantised_mesh

    grid = np.add.outer(np.arange(5) * 10.0, np.arange(5))
    header, (u, v, h), triangles, edges = decode_mesh(quantised_mesh(grid, 0, 0, 10, 10, 2))
    assert header[3:5] == (0.0, 44.0) and len(u) == 9 and len(triangles) == 8 and [len(e) for e in edges] == [3] * 4
    got = {(int(a), int(b)): c / 32767 * 44 for a, b, c in zip(u, v, h)}
    assert abs(got[0, 32767]) < 0.01 and abs(got[32767, 0] - 44) < 0.01 and abs(got[16383, 16383] - 22) < 0.01
    x, y = u[triangles], v[triangles]
    area = (x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])
    assert (area > 0).all() and abs(area.sum() / 2 - 32767**2) < 1e6
    assert abs(np.linalg.norm(header[:3]) - 6.37e6) < 5e4 and header[8] > 5e5 and 1 <= np.linalg.norm(header[9:]) < 1.1
    plain, shaded = quantised_mesh(grid * 0, 0, 0, 10, 10), quantised_mesh(grid * 0, 0, 0, 10, 10, normals=True)
    assert shaded.startswith(plain) and struct.unpack_from("<BI", shaded, len(plain)) == (1, 50) and len(shaded) == len(plain) + 55
    header, (u, v, h), _, _ = decode_mesh(plain)
    packed = np.frombuffer(shaded, np.uint8, 50, len(plain) + 5).reshape(-1, 2) / 255 * 2 - 1
    z = 1 - np.abs(packed).sum(1)
    xy = np.where(z[:, None] < 0, (1 - np.abs(packed[:, ::-1])) * np.where(packed < 0, -1, 1), packed)
    n = np.concatenate([xy, z[:, None]], axis=1)
    up = ecef(u * 10 / 32767, v * 10 / 32767, h * 0.0)
    cos = (n * up).sum(1) / np.linalg.norm(n, axis=1) / np.linalg.norm(up, axis=1)
    assert (cos > 0.99).all()  # flat ground faces away from the earth's middle
    cells = spark.createDataFrame([(r, c, r + c) for r in range(3) for c in range(3)], "row long, col long, elev long")
    bodies = mesh_bytes(tiles.heightmaps(cells, 3, 5)).collect()
    assert len(decode_mesh(bytes(next(b.body for b in bodies if (b.x, b.y) == (0, 0))))[1][0]) == 9
