"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from orospark.functions import display, labels, progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def text(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(("chunk", "current", "want"), [("0...10...20", 0, 20), ("...30...40", 20, 40), ("100 - done.", 40, 100), ("Processing: 42.5%", 0, 42.5), ("nothing", 7, 7), ("50%", 60, 60), ("150%", 0, 100), ("2024-09-01 x", 0, 100), ("", 3, 3)])
def test_progress_of_a_chunk(spark, chunk, current, want):
    assert one(spark, progress.parse_progress(text(chunk), F.lit(float(current)))) == want


def test_lenient_progress_leaves_out_years(spark):
    assert one(spark, progress.parse_progress(text("2024-09-01 x"), F.lit(5.0), strict=False)) == 5


@pytest.mark.parametrize(("line", "zoom"), [("generating overview for zoom level 12", 12), ("zoom=8", 8), ("no zoom here", None), ("Overview: 3", 3), (None, None)])
def test_zoom_of_a_line(spark, line, zoom):
    assert one(spark, progress.parse_zoom(text(line))) == zoom


def test_overall_percent(spark):
    p = lambda s, v, r=None: one(spark, progress.overall_percent(F.lit(s), F.lit(float(v)), r))
    assert (p("gdal_preprocess", 0), p("gdal_preprocess", 100), p("ctb_tile", 50), p("unknown", 30), p("ctb_tile", 900)) == (2.0, 25.0, 60.0, 30.0, 95.0)
    assert p("ctb_tile", 50, {"ctb_tile": (10.0, 95.0)}) == 52.5
    s = lambda st, v: one(spark, progress.shown_percent(F.lit(st), F.lit(float(v))))
    assert (s("done", 0), s("failed", 100)) == (100.0, 99.99)


def test_elapsed(spark):
    e = lambda c, d, s, u, n: one(spark, progress.elapsed_seconds(text(c), text(d), text(s), text(u), text(n)))
    day = "2024-06-01T07:"
    assert e(day + "00:00+00:00", None, "running", None, day + "00:42+00:00") == 42.0
    assert e(day + "00:00", day + "01:30", "completed", None, day + "59:00") == 90.0
    assert e(day + "00:00", None, "failed", None, day + "59:00") == 0.0
    assert e("bad", None, "running", None, day + "59:00") is None
    assert e(day + "10:00", day + "09:00", "completed", None, None) == 0.0


def test_status_and_flags(spark):
    n = lambda s: one(spark, progress.normal_status(text(s)))
    assert [n(s) for s in (None, " ", "Tiling", "odd", "completed")] == ["queued", "queued", "tiling", "running", "completed"]
    assert one(spark, progress.stage_of_status(F.lit("publishing"))) == "register_tileset"
    assert one(spark, progress.flag_unsupported(F.lit("ERROR: Unknown argument: --progress")))
    assert not one(spark, progress.flag_unsupported(F.lit("unknown option -x")))
    assert tuple(one(spark, progress.restored_progress(F.lit("failed"), F.lit("disk full")))) == (0.0, "failed", "disk full")
    assert [one(spark, progress.retry_millis(F.lit(k))) for k in (1, 2, 5, 9)] == [1000, 2000, 15000, 15000]
    assert tuple(round(x, 2) for x in one(spark, progress.step_weights(F.lit(True), F.lit(False)))) == (0.85, 0.15, 0.0)
    assert one(spark, progress.step_percent(F.lit(90.0), F.lit(80.0), F.lit(0.5))) == 100.0


@pytest.mark.parametrize(("name", "want"), [("../evil", None), ("string", "job"), ("STRING ", "job"), (None, "job"), ("  ", "job"), (" a ", "a"), ("a\\b", None), (".", None), (".x", None), ("a..b", None), ("\n", "job"), ("\u3000\ta\r\n", "a"), ("a\nb", "a\nb")])
def test_tileset_names(spark, name, want):
    assert one(spark, labels.tileset_name(F.lit("job"), text(name))) == want


@pytest.mark.parametrize("raw", ["", " ", "\t\n", "\x1c", "\u00a0x\u2003", "a  b", " a\n\n", None, "\n a \n b \n"])
def test_trimming_is_that_of_strings(spark, raw):
    assert one(spark, labels.trim_to_null(text(raw))) == ((raw or "").strip() or None)


def test_labels(spark):
    assert one(spark, labels.format_label(F.lit("quantized-mesh-1.0"))) == "量化网格 (Mesh)"
    assert one(spark, labels.crs_label(F.lit("EPSG:3857"))) == "EPSG:3857 (Web 墨卡托)"
    assert one(spark, labels.format_label(F.lit(""))) is None and one(spark, labels.crs_label(F.lit("EPSG:2154"))) == "EPSG:2154"
    assert one(spark, labels.job_of_tiles(F.lit("/data/jobs/abc-123/tiles"))) == "abc-123"
    assert one(spark, labels.job_of_tiles(F.lit("/data/other/tiles"))) is None
    assert one(spark, labels.terrain_url(F.lit("http://h/"), F.lit("/t/"), F.lit("n"))) == "http://h/t/n"


def test_paths(spark):
    assert [one(spark, labels.suffix(text(n))) for n in ("a.TIF", ".tif", "x", "a.b.img")] == [".tif", "", "", ".img"]
    assert one(spark, labels.parent_path(F.lit("a/b"))) == "a" and one(spark, labels.parent_path(F.lit("a"))) == "" and one(spark, labels.parent_path(F.lit(""))) is None
    assert one(spark, labels.child_path(F.lit(""), F.lit("n"))) == "n" and one(spark, labels.child_path(F.lit("a"), F.lit("n"))) == "a/n"
    assert one(spark, labels.in_reserved_folder(F.lit("jobs/x"))) and not one(spark, labels.in_reserved_folder(F.lit("x/jobs")))
    assert [one(spark, labels.bind_source(text(p))) for p in ("D:\\foo\\bar", "D:", "/data", "rel\\x")] == ["//d/foo/bar", "//d", "/data", "rel/x"]


def test_rectangles_and_numbers(spark):
    assert tuple(one(spark, display.tile_rectangle(*[F.lit(k) for k in (0, 0, 0, 1, 0)]))) == (-180.0, -90.0, 180.0, 90.0)
    assert tuple(one(spark, display.tile_rectangle(*[F.lit(k) for k in (1, 2, 1, 2, 1)]))) == (0.0, 0.0, 90.0, 90.0)
    assert abs(one(spark, display.span_metres(*[F.lit(float(k)) for k in (0, -1, 2, 1)])) - 222638.98) < 1
    assert [one(spark, display.camera_height(F.lit(float(s)))) for s in (10, 100_000, 1e9)] == [3000.0, 55000.00000000001, 120000.0]
    assert one(spark, display.show_degrees(F.lit(-12.5), "E", "W")) == "W12.50000°"
    assert [one(spark, display.show_height(F.lit(h))) for h in (-1.26, 0.01, 99.0)] == ["-1.3 m（椭球面下）", "0.0 m（椭球面）", "99.0 m"]
    assert [one(spark, display.show_size(F.lit(b).cast("long"))) for b in (5, 1280, 3 << 20, 5 << 30)] == ["5 B", "1.3 KB", "3.0 MB", "5.00 GB"]
    assert [one(spark, display.show_elapsed(F.lit(float(s)))) for s in (5, 65, 3725)] == ["5秒", "1分5秒", "1小时2分5秒"]
    assert [one(spark, display.show_zooms(F.lit(a), F.lit(b))) for a, b in ((1, 1), (0, 3))] == ["1", "0–3"]
    assert [one(spark, display.show_percent(F.lit(p))) for p in (42.0, 42.25, 120.0, -5.0)] == ["42%", "42.3%", "100%", "0%"]
    assert one(spark, display.ramp_colour(display.ramp_step(F.lit(3000.0), F.lit(-500.0), F.lit(3000.0)))) == "#fffdfd"
    assert one(spark, display.exaggeration(F.lit(None).cast("double"))) == 1.0


def test_shading(spark):
    assert one(spark, display.shade(F.lit(5.0), "ocean", 0.0, 10.0, F.lit(True))) == "#ffffff"
    assert one(spark, display.shade(F.lit(None).cast("double"), "ocean", 0.0, 10.0)) is None
    assert display.checked_range(1.0, 2.0) == (1.0, 2.0)
    assert one(spark, display.shade(F.lit(-5.0), "ocean", 0.0, 10.0, F.lit(False))) == one(spark, display.shade(F.lit(0.0), "ocean", 0.0, 10.0))
    with pytest.raises(ValueError, match="over"):
        display.shade(F.lit(1.0), "ocean", 5.0, 5.0)
