import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orospark.operators import raster
from orospark.plans.options import PreprocessOptions, PublishOptions, TileOptions
from orospark.sources import geotiff, sinks


def cells(spark, grid):
    return spark.createDataFrame([(r, c, None if v is None else int(v)) for r, line in enumerate(grid) for c, v in enumerate(line)], "row long, col long, elev long")


def test_overviews_come_from_the_level_before(spark):
    grid = np.arange(256).reshape(16, 16)
    out = raster.overviews(cells(spark, grid.tolist()))
    for f in (2, 4, 8, 16):
        want = grid.reshape(16 // f, f, 16 // f, f).mean((1, 3))
        assert {(r.row, r.col): r.elev for r in out[f].collect()} == {(i, j): want[i, j] for i in range(16 // f) for j in range(16 // f)}


@pytest.mark.parametrize("method", raster.METHODS)
def test_resampling_flat_ground(spark, method):
    got = raster.resample(cells(spark, [[7] * 8] * 8), 2, method).collect()
    assert len(got) == 16 and all(r.elev == 7 for r in got)


def test_resampling_needs_values_and_known_methods(spark):
    got = raster.resample(cells(spark, [[None, None], [None, None]]), 2, "average").collect()
    assert [r.elev for r in got] == [None]
    with pytest.raises(ValueError, match="no resampling"):
        raster.resample(cells(spark, [[1]]), 2, "magic")
    with pytest.raises(ValueError, match="even"):
        raster.resample(cells(spark, [[1]]), 3, "cubic")


def test_filling_keeps_valid_cells_and_far_gaps(spark):
    line = [5] + [None] * 11
    got = {r.col: r.filled for r in raster.fill_nodata(cells(spark, [line])).collect()}
    assert got == {0: 5.0} | {c: 5.0 for c in range(1, 11)} | {11: None}


def test_rescaling_by_one_changes_nothing(spark):
    grid = [[1, 2, 3], [4, 5, 6]]
    assert {(r.row, r.col): r.elev for r in raster.rescale_bilinear(cells(spark, grid), 1, 1).collect()} == {(i, j): float(grid[i][j]) for i in range(2) for j in range(3)}


def test_rescaling_of_two_rasters_at_once(spark):
    a = cells(spark, [[0, 10]]).withColumn("id", F.lit("a"))
    b = cells(spark, [[100, 200]]).withColumn("id", F.lit("b"))
    got = raster.rescale_bilinear(a.union(b), 1, 2, ("id",)).collect()
    assert {(r.id, r.col): r.elev for r in got if r.row == 0} == {("a", 0): 0.0, ("a", 1): 5.0, ("a", 2): 10.0, ("b", 0): 100.0, ("b", 1): 150.0, ("b", 2): 200.0}


def test_mercator_rows_spread_towards_the_pole(spark):
    rows = raster.mercator_rows(80.0, 0.0, 81, spark)
    at = {r.target: r.s / r.w for r in rows.groupBy("target").agg(F.sum(F.col("source") * F.col("weight")).alias("s"), F.sum("weight").alias("w")).collect()}
    y = np.linspace(np.log(np.tan(np.radians(85))), 0, 81)
    want = 80 - (2 * np.degrees(np.arctan(np.exp(y))) - 90)
    assert max(abs(at[k] - want[k]) for k in range(81)) < 1e-5
    ramp = cells(spark, [[k * 1000] for k in range(81)])
    got = {r.row: r.elev for r in raster.remap_rows(ramp, rows).collect()}
    assert max(abs(got[k] - want[k] * 1000) for k in range(81)) < 0.01


def plain_samples(grid, rows, cols, method):
    """resample_onto() sample by sample, from the definition."""
    wide = {"bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}
    h, w = len(grid), len(grid[0])

    def weight(t):
        if method == "bilinear":
            return 1 - t
        if method == "cubic":
            return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2
        if method == "cubicspline":
            return 2 / 3 - t**2 + t**3 / 2 if t < 1 else (2 - t) ** 3 / 6
        return np.sinc(t) * np.sinc(t / 3)

    up = lambda k: np.sign(k) * np.floor(abs(k) * 1e6 + 0.5)
    out = {}
    for i in range(-9, 4 * h):
        for j in range(-9, 4 * w):
            y, x = rows[0] + rows[1] * i, cols[0] + cols[1] * j
            if method in wide:
                t, s = 0.0, 0.0
                for c in range(w):  # rows first, as they are normalised together in the end
                    for r in range(h):
                        a, b = abs(y - r) / max(1, rows[1]), abs(x - c) / max(1, cols[1])
                        if grid[r][c] is not None and a < wide[method] and b < wide[method]:
                            k = up(weight(a)) * up(weight(b))
                            t, s = t + k * grid[r][c], s + k
                if s > 0:
                    out[i, j] = t / s
                continue
            a, b = max(0.5, rows[1] / 2), max(0.5, cols[1] / 2)
            near = [(round((y - r) ** 2 + (x - c) ** 2, 9), r, c, grid[r][c]) for r in range(h) for c in range(w) if grid[r][c] is not None and -a <= y - r < a and -b <= x - c < b]
            v = sorted(n[3] for n in near)
            if near:
                pick = lambda q: v[max(0, int(np.ceil(q * len(v))) - 1)]  # noqa: B023, E731
                out[i, j] = {"nearest": min(near)[3], "average": sum(v) / len(v), "min": v[0], "max": v[-1], "med": pick(0.5), "q1": pick(0.25), "q3": pick(0.75), "mode": max(v, key=lambda e: (v.count(e), -e))}[method]
    return out


@pytest.mark.parametrize("method", raster.METHODS)
def test_resampling_onto_samples(spark, method):
    rng = np.random.default_rng(3)
    grid = [[None if rng.random() < 0.1 else int(rng.integers(0, 6)) for _ in range(9)] for _ in range(7)]
    df = cells(spark, grid)
    for rows, cols in (((0.25, 1.5), (-0.5, 2.0)), ((0.0, 0.4), (0.3, 1.0))):
        got = {(r.row, r.col): r.elev for r in raster.resample_onto(df, rows, cols, method).collect()}
        want = plain_samples(grid, rows, cols, method)
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-6 * (1 + abs(want[k])) for k in got), [(k, got[k], want[k]) for k in got if abs(got[k] - want[k]) > 1e-6][:5]


def test_mercator_and_back(spark):
    ramp = cells(spark, [[k * 1000] for k in range(81)])
    there = raster.remap_rows(ramp, raster.mercator_rows(80.0, 0.0, 81, spark))
    back = {r.row: r.elev for r in raster.remap_rows(there, raster.latitude_rows(80.0, 0.0, 81, spark)).collect()}
    assert max(abs(back[k] - k * 1000) for k in range(81)) < 250  # linear pieces of a curve


def test_wider_contours(spark):
    line = cells(spark, [[0, 0, 200, 200, 200, 200]])
    on = lambda w: [r.col for r in raster.contours(line, 150, w).where("contour").orderBy("col").collect()]
    assert on(1) == [1] and on(2) == [1, 2] and on(4) == [1, 2, 3, 4]


def test_slope_of_a_plane(spark):
    got = {(r.row, r.col): r for r in raster.slope_aspect(cells(spark, [[100 * c for c in range(3)]] * 3), 100.0).collect()}
    assert abs(got[1, 1].slope - 45) < 1e-9 and abs(got[1, 1].aspect - 270) < 1e-9 and got[0, 0].slope is None


def test_blocks_round_trip(spark):
    grid = [[r * 40 + c for c in range(40)] for r in range(20)]
    blocks = raster.to_blocks(cells(spark, grid), 16)
    assert blocks.count() == 6 and raster.from_blocks(blocks).exceptAll(cells(spark, grid)).count() == 0
    with pytest.raises(ValueError, match="16"):
        raster.to_blocks(blocks, 65)


def test_preprocessing_fills_before_overviews(spark):
    out, levels = raster.preprocess(cells(spark, [[1, -9999], [1, 1]]), nodata=-9999)
    assert sorted(r.elev for r in out.collect()) == [1.0] * 4 and levels[2].first().elev == 1.0


def tiff(grid, nodata=None, tiled=False, deflate=True, at=None, keys=None):
    g = np.asarray(grid, "<f4")
    h, w = g.shape
    if tiled:
        padded = np.zeros((-(-h // 16) * 16, -(-w // 16) * 16), "<f4")
        padded[:h, :w] = g
        parts = [padded[r : r + 16, c : c + 16].tobytes() for r in range(0, padded.shape[0], 16) for c in range(0, padded.shape[1], 16)]
    else:
        parts = [g[r : r + 2].tobytes() for r in range(0, h, 2)]
    parts = [zlib.compress(p) for p in parts] if deflate else parts
    body, offsets = b"", []
    for p in parts:
        offsets.append(8 + len(body))
        body += p
    extra, entries = b"", []
    base = 8 + len(body)

    def add(tag, kind, values):
        nonlocal extra
        raw = values.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{'H' if kind == 3 else 'd' if kind == 12 else 'I'}", *values)
        n = len(raw) if kind == 2 else len(values)
        if len(raw) > 4:
            place = struct.pack("<I", base + len(extra))
            extra += raw
        else:
            place = raw.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, kind, n) + place)

    add(256, 4, [w])
    add(257, 4, [h])
    add(258, 3, [32])
    add(259, 3, [8 if deflate else 1])
    if not tiled:
        add(273, 4, offsets)
        add(278, 4, [2])
        add(279, 4, [len(p) for p in parts])
    else:
        add(322, 4, [16])
        add(323, 4, [16])
        add(324, 4, offsets)
        add(325, 4, [len(p) for p in parts])
    add(339, 3, [3])
    if at:
        west, north, size = at
        add(33550, 12, [size, size, 0.0])
        add(33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])
    if keys:
        add(34735, 3, keys)
    if nodata is not None:
        add(42113, 2, str(nodata))
    return b"II*\0" + struct.pack("<I", base + len(extra)) + body + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("deflate", [False, True])
def test_reading_elevation_files(spark, tmp_path, tiled, deflate):
    grid = np.arange(5 * 20, dtype=float).reshape(5, 20)
    grid[2, 3] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(grid, -9999, tiled, deflate))
    got = geotiff.read_dem(spark, f"file://{tmp_path}/a.tif").collect()
    assert {(r.row, r.col): r.elev for r in got} == {(i, j): None if (i, j) == (2, 3) else grid[i, j] for i in range(5) for j in range(20)}
    assert geotiff.place(tiff(grid)) == (-180.0, 90.0, 18.0, 36.0, 5, 20)
    assert geotiff.place(tiff(grid, at=(10.0, 50.0, 0.25))) == (10.0, 50.0, 0.25, 0.25, 5, 20)
    with pytest.raises(ValueError, match="TIFF"):
        geotiff.decode(b"not one at all")


def pack_lzw(data):
    """The format's own compression, by its specification."""
    codes, out, held, n = {bytes([k]): k for k in range(256)}, bytearray(), 0, 0
    width, following = 9, 258

    def put(code):
        nonlocal held, n
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
            held &= (1 << n) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in codes:
            word += c
            continue
        put(codes[word])
        codes[word + c] = following
        following += 1
        if following in (511 + 1, 1023 + 1, 2047 + 1):
            width += 1
        if following == 4094:
            put(256)
            codes, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        word = c
    if word:
        put(codes[word])
    put(257)
    if n:
        out.append(held << (8 - n) & 255)
    return bytes(out)


def test_lzw():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", b"aaaaaaaaaa" * 300, bytes(rng.integers(0, 256, 20_000, dtype=np.uint8)), bytes(rng.integers(0, 3, 60_000, dtype=np.uint8))):
        assert geotiff.unpack_lzw(pack_lzw(data)) == data


def differenced(block, predictor):
    """Rows of a block as predictors 2 and 3 leave them."""
    if predictor == 2:
        whole = block.view(f"<u{block.itemsize}")
        return np.diff(whole, axis=1, prepend=np.zeros((len(block), 1), whole.dtype)).astype(whole.dtype).tobytes()
    size = block.itemsize
    planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(len(block), -1, size).transpose(0, 2, 1).reshape(len(block), -1)
    return np.diff(planes, axis=1, prepend=np.zeros((len(block), 1), np.uint8)).astype(np.uint8).tobytes()


def any_tiff(grid, packing, predictor, big, rows=4):
    """A striped file of either size of directory; the last strip has no bytes."""
    h, w = grid.shape
    kind = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    pack = {1: bytes, 5: pack_lzw, 8: zlib.compress}[packing]
    parts = [pack(grid[r : r + rows].tobytes() if predictor == 1 else differenced(np.ascontiguousarray(grid[r : r + rows]), predictor)) for r in range(0, h, rows)] + [b""]
    head = 16 if big else 8
    offsets = [head + sum(map(len, parts[:k])) for k in range(len(parts))]
    entries = {256: (3, [w]), 257: (3, [h + rows]), 258: (3, [grid.itemsize * 8]), 259: (3, [packing]), 273: (16 if big else 4, offsets), 278: (3, [rows]), 279: (4, [len(p) for p in parts]), 317: (3, [predictor]), 339: (3, [kind]), 42113: (2, b"-7\0")}
    at = head + sum(map(len, parts))
    extra, listed, room = b"", b"", 8 if big else 4
    for tag, (t, values) in entries.items():
        raw = values if t == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[t] }", *values)
        spot = raw.ljust(room, b"\0")
        if len(raw) > room:
            spot = struct.pack("<Q" if big else "<I", at + len(extra))
            extra += raw
        listed += struct.pack("<HHQ" if big else "<HHI", tag, t, len(values)) + spot
    ifd = at + len(extra)
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, ifd) if big else struct.pack("<2sHI", b"II", 42, ifd)
    return start + b"".join(parts) + extra + struct.pack("<Q" if big else "<H", len(entries)) + listed + b"\0" * 8


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize(("kind", "predictor"), [("<f4", 1), ("<f4", 3), ("<f8", 3), ("<i2", 2), ("<u4", 2), ("<u1", 1)])
@pytest.mark.parametrize("big", [False, True])
def test_ways_of_packing(packing, kind, predictor, big):
    rng = np.random.default_rng(1)
    grid = (rng.integers(0, 200, (8, 33)) * (1.5 if "f" in kind else 1)).astype(kind)
    band, nodata = geotiff.decode(any_tiff(grid, packing, predictor, big))
    assert nodata == -7 and np.array_equal(band[:8], grid) and (band[8:] == np.full((4, 33), -7).astype(kind)).all()


def test_blocks_are_read_by_range(spark, tmp_path):
    grid = np.arange(8 * 33, dtype="<f4").reshape(8, 33)
    for k in range(2):
        (tmp_path / f"a {k}.tif").write_bytes(any_tiff(grid + k, 5, 3, bool(k)))
    path = f"file://{tmp_path}/*.tif"
    assert geotiff.read_blocks(spark, path).count() == 6
    got = geotiff.read_dem(spark, path).collect()
    assert {(r.raster_id[-5], r.row, r.col): r.elev for r in got} == {(str(k), i, j): grid[i, j] + k if i < 8 else None for k in range(2) for i in range(12) for j in range(33)}
    assert {r.crs for r in geotiff.read_places(spark, path).collect()} == {None}


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/tiles"
    t = spark.createDataFrame([(0, 0, 0, 5), (1, 1, 0, 6)], "z int, x long, y long, v int")
    sinks.write_tiles(t, path)
    sinks.write_tiles(t.union(spark.createDataFrame([(1, 2, 0, 7)], t.schema)).withColumn("v", F.col("v") + 100), path, resume=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [5, 6, 107]
    sinks.write_blocks(cells(spark, [[1] * 20] * 20), f"file://{tmp_path}/b", 16)
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 4
    sinks.write_text(spark.createDataFrame([("{}",)], "t string"), f"file://{tmp_path}/j", "t")
    assert spark.read.text(f"file://{tmp_path}/j").first().value == "{}"


def test_options():
    assert PreprocessOptions().target_crs == "EPSG:4326" and TileOptions().end_zoom == 0
    for bad in (lambda: PreprocessOptions(block_size=65), lambda: PreprocessOptions(target_crs="EPSG:2154"), lambda: TileOptions(resampling_method="x"), lambda: TileOptions(start_zoom=-1), lambda: TileOptions(mesh_qfactor=0)):
        with pytest.raises(ValueError):
            bad()
    assert TileOptions().flags() == ["-f", "Mesh", "-p", "geodetic", "-r", "average", "-z", "0.125", "-e", "0", "-C", "-N"]
    t = TileOptions(output_format="Terrain", start_zoom=5, resume=True, mesh_qfactor=2.0, layer_only=True, creation_options=("A=1",), quiet=True)
    assert t.flags()[8:] == ["-s", "5", "-e", "0", "-R", "-g", "2.0", "-l", "-C", "-q", "-n", "A=1"]
    assert PublishOptions().publishes(True) and not PublishOptions(auto_publish=False).publishes(True)
