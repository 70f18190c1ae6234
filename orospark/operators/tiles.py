"""Tile addresses, pyramids, availability catalogues and tile payloads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.functions.labels import FORMATS, PROJECTIONS

AVAILABLE = T.ArrayType(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("startX", "startY", "endX", "endY")])))
DESCRIPTOR = T.StructType([T.StructField("format", T.StringType()), T.StructField("projection", T.StringType()), T.StructField("bounds", T.ArrayType(T.DoubleType())), T.StructField("available", AVAILABLE)])
#: Web Mercator reaches so far north and south.
MERCATOR_LIMIT = 85.05112877980659


def tile_xy(lon: Column, lat: Column, zoom: Column, profile: str = "geodetic") -> tuple[Column, Column]:
    """Column and row (from the south) of the tile that holds a place; the far edges belong to the last tile."""
    n = F.pow(F.lit(2.0), zoom)
    if profile == "geodetic":
        nx, ny = n * 2, n
        x, y = (lon + 180.0) / 360.0 * nx, (lat + 90.0) / 180.0 * ny
    elif profile == "mercator":
        nx = ny = n
        inside = F.least(F.greatest(lat, F.lit(-MERCATOR_LIMIT)), F.lit(MERCATOR_LIMIT))
        x = (lon + 180.0) / 360.0 * nx
        y = (F.log(F.tan(F.radians(F.lit(45.0) + inside / 2))) / (2 * 3.141592653589793) + 0.5) * ny
    else:
        raise ValueError(f"no profile {profile}")
    clamp = lambda v, m: F.least(F.greatest(F.floor(v), F.lit(0)), m.cast("long") - 1).cast("long")
    return clamp(x, nx), clamp(y, ny)


def whole_degree_tiles(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Geodetic tile of whole degrees east of -180 and north of -90, in integer arithmetic."""
    return F.floor(lon * (2 << zoom) / 360).cast("long"), F.floor(lat * (1 << zoom) / 180).cast("long")


#: Levels that a row goes up before it is aggregated again.
BAND = 4


def pyramid(tiles: DataFrame, end_zoom: int = 0, keys: tuple[str, ...] = (), deepest: int = 23) -> DataFrame:
    """All zooms of tiles (z, x, y, elev; z at most deepest): n, total, least and most elevation of each tile, from the zoom it
    comes with down to end_zoom.

    Rows are aggregated once, at the zoom they come with. The sums then go up by bands of a few levels, each band from the
    topmost sums of the one below, so the work falls by the number of tiles in a band's height and not by a row's number of
    levels. Rows may come at several zooms."""
    at = [*keys, "z", "x", "y"]
    added = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")]
    sums = tiles.groupBy(*at).agg(F.count("elev").alias("n"), F.sum("elev").alias("total"), F.min("elev").alias("least"), F.max("elev").alias("most"))
    levels, carried = [], None
    up = lambda d, by: d.withColumn("_up", by).withColumn("z", (F.col("z") - F.col("_up")).cast("int")).withColumn("x", F.expr("shiftright(x, _up)")).withColumn("y", F.expr("shiftright(y, _up)")).drop("_up")
    sums = sums.withColumn("z", F.col("z").cast("int"))
    for low in range((deepest - end_zoom) // BAND * BAND + end_zoom, end_zoom - 1, -BAND):
        own = sums.where(F.col("z").between(low, low + BAND - 1))
        rows = own if carried is None else own.unionByName(up(carried, F.lit(1)))
        band = up(rows, F.explode(F.sequence(F.lit(0), F.col("z") - low))).groupBy(*at).agg(*added)
        levels.append(band)
        carried = band.where(F.col("z") == low)
    out = sums.where(F.col("z") < end_zoom)
    for band in levels:
        out = out.unionByName(band)
    return out


def pyramid_extents(tiles: DataFrame, end_zoom: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """extents(pyramid(tiles)) without the pyramid: halving keeps order, so a box's corners go up instead of its tiles. One
    aggregate over the tiles, the rest over a row for each zoom."""
    boxes = extents(tiles, keys).withColumn("z", F.col("z").cast("int"))
    way = boxes.withColumn("_up", F.explode(F.sequence(F.lit(0), F.greatest(F.col("z") - end_zoom, F.lit(0)))))
    corners = [F.expr(f"shiftright({c}, _up)").alias(c) for c in ("startX", "startY", "endX", "endY")]
    way = way.select(*keys, (F.col("z") - F.col("_up")).alias("z"), *corners)
    return way.groupBy(*keys, "z").agg(*[f(c).alias(c) for c, f in (("startX", F.min), ("startY", F.min), ("endX", F.max), ("endY", F.max))])


def extents(tiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(z, startX, startY, endX, endY): one bounding box for each zoom that has tiles."""
    return tiles.groupBy(*keys, "z").agg(F.min("x").alias("startX"), F.min("y").alias("startY"), F.max("x").alias("endX"), F.max("y").alias("endY"))


def runs(tiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact availability: for each zoom and row of tiles, the runs of columns without holes."""
    w = Window.partitionBy(*keys, "z", "y").orderBy("x")
    group = F.col("x") - F.row_number().over(w)
    t = tiles.select(*keys, "z", "x", "y").distinct().withColumn("_g", group)
    return t.groupBy(*keys, "z", "y", "_g").agg(F.min("x").alias("startX"), F.max("x").alias("endX")).select(*keys, "z", "startX", F.col("y").alias("startY"), "endX", F.col("y").alias("endY"))


def available_levels(boxes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Boxes with the zooms between 0 and the deepest that have none filled in, is_empty telling which."""
    top = boxes.groupBy(*keys).agg(F.max("z").alias("_top")).where("_top is not null")
    every = top.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))).alias("z"))
    return every.join(boxes.withColumn("z", F.col("z").cast("int")), [*keys, "z"], "left").withColumn("is_empty", F.col("startX").isNull())


def available(boxes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tileset: available, the array by zoom of its boxes, [] at gaps."""
    box = F.struct(*[F.col(n).cast("int").alias(n) for n in ("startX", "startY", "endX", "endY")])
    levels = available_levels(boxes, keys).groupBy(*keys, "z").agg(F.array_sort(F.collect_list(F.when(~F.col("is_empty"), box))).alias("boxes"))
    return levels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "boxes"))), lambda s: s["boxes"]).alias("available"))


def zoom_range(available: Column) -> Column:
    """(min_zoom, max_zoom) of the zooms that have boxes; nulls when none has."""
    zooms = F.filter(F.transform(available, lambda boxes, z: F.when(F.size(boxes) > 0, z)), lambda z: z.isNotNull())
    return F.struct(F.array_min(zooms).alias("min_zoom"), F.array_max(zooms).alias("max_zoom"))


def descriptor(boxes: DataFrame, output_format: str = "Mesh", profile: str = "geodetic", keys: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """Layer descriptor of each tileset as JSON text, keys in order of their names."""
    # The descriptor's names, version, scheme and address pattern.
    whole = F.array(*[F.lit(x) for x in (-180.0, -90.0, 180.0, 90.0)])
    fields = {
        "tilejson": F.lit("2.1.0"), "format": F.lit(FORMATS[output_format]), "version": F.lit("1.0.0"), "scheme": F.lit("tms"),
        "tiles": F.array(F.lit("{z}/{x}/{y}.terrain?v={version}")), "projection": F.lit(PROJECTIONS[profile]), "bounds": whole, "available": F.col("available"),
    } | ({"extensions": F.array(*[F.lit(x) for x in extensions])} if extensions else {})
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return available(boxes, keys).select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("layer_json"))


def keep_or_generate(existing: Column, generated: Column) -> Column:
    """An existing descriptor stays if it is readable and has anything available."""
    return F.when(F.size(F.from_json(existing, DESCRIPTOR)["available"]) > 0, existing).otherwise(generated)


def coverage(layers: DataFrame, available_column: str = "available", projection: str = "projection", bounds: str = "bounds") -> DataFrame:
    """layers with cover (z and box of the deepest zoom that has one, its first) and declared: bounds for other projections."""
    found = F.filter(F.transform(F.col(available_column), lambda boxes, z: F.struct(z.alias("z"), F.get(boxes, F.lit(0)).alias("box"))), lambda s: s["box"].isNotNull())
    geodetic = F.upper(F.coalesce(F.col(projection), F.lit("EPSG:4326"))) == "EPSG:4326"
    return layers.withColumn("cover", F.when(geodetic, F.try_element_at(found, F.lit(-1)))).withColumn("declared", F.when(~geodetic & (F.size(found) > 0) & (F.size(bounds) == 4), F.col(bounds)))


def missing_tiles(wanted: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Resume: wanted tiles that don't exist yet."""
    return wanted.join(existing.select(*keys, "z", "x", "y").distinct(), [*keys, "z", "x", "y"], "left_anti")


def with_roots(tiles: DataFrame, profile: str = "geodetic") -> DataFrame:
    """(z, x, y, is_added) of tiles and of the root tiles that they lack: two for geodetic, one for mercator."""
    spark = tiles.sparkSession
    roots = spark.range(2 if profile == "geodetic" else 1).select(F.lit(0).alias("z"), F.col("id").alias("x"), F.lit(0).cast("long").alias("y"))
    own = tiles.select(F.col("z").cast("int").alias("z"), "x", "y").distinct()
    added = roots.join(own.where("z = 0"), ["z", "x", "y"], "left_anti")
    return own.withColumn("is_added", F.lit(False)).unionByName(added.withColumn("is_added", F.lit(True)))


def _shared(axis: str, step: int) -> Column:
    """The tiles that a sample lies in: one, or both that share it as their edge."""
    return F.array_distinct(F.array(F.expr(f"{axis} div {step}"), F.expr(f"case when {axis} % {step} = 0 and {axis} > 0 then {axis} div {step} - 1 else {axis} div {step} end")))


def heightmaps(cells: DataFrame, size: int = 65, zoom: int = 0, keys: tuple[str, ...] = (), missing: int = 0, south_up: bool = False) -> DataFrame:
    """(z, x, y, samples, filled): tiles of size x size samples that share their edges with the next, in rows from the north.

    Cell (row, col) is a sample of up to four tiles; rows count from the north, with south_up from the south, as tiles then
    do. A sample is the height in fifths of a metre above -1000, as heightmap-1.0 has it, clamped to 16 bits; nodata and
    absent cells are ``missing``. Of two cells at one place the higher counts."""
    step = size - 1
    t = cells.withColumn("_ty", F.explode(_shared("row", step))).withColumn("_tx", F.explode(_shared("col", step)))
    j = F.col("row") - F.col("_ty") * step
    place = (F.lit(step) - j if south_up else j) * size + (F.col("col") - F.col("_tx") * step)
    height = F.least(F.greatest(F.floor((F.col("elev") + 1000) * 5), F.lit(0)), F.lit(65535)).cast("int")
    spot = F.when(F.col("elev").isNotNull(), (place * 65536 + height).cast("long"))
    out = t.groupBy(*keys, F.lit(zoom).alias("z"), F.col("_tx").alias("x"), F.col("_ty").alias("y")).agg(F.array_sort(F.collect_list(spot)).alias("_k"))
    schema = T.StructType([*out.schema.fields[:-1], T.StructField("samples", T.ArrayType(T.IntegerType())), T.StructField("filled", T.IntegerType())])

    def scatter(batches):
        for b in batches:
            spots = b.column(b.num_columns - 1)
            ends = spots.offsets.to_numpy().astype(np.int64)
            known = spots.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            tile = np.repeat(np.arange(b.num_rows), np.diff(ends))
            grid = np.full(b.num_rows * size * size, missing, np.int32)
            at = tile * size * size + (known >> 16)
            grid[at] = known & 65535
            last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
            filled = np.bincount(tile[last], minlength=b.num_rows).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * size * size, pa.int32()), pa.array(grid))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(filled)], names=schema.names)

    return out.mapInArrow(scatter, schema)


def mesh_step(size: int, quality: float) -> int:
    """Spacing of a mesh's vertices: the quality factor rounded down to a power of two, a tile's width at most."""
    every = 1
    while every * 2 <= min(quality, size - 1):
        every *= 2
    return every


def mesh_vertices(cells: DataFrame, size: int = 65, quality: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantised vertices (tile_x, tile_y, u, v, h from 0 to 32767) of a regular mesh on each tile's grid.

    A tile's edge rows and columns are always kept, and a cell on an edge is a vertex of both tiles, so tiles meet.
    Heights are scaled between the extremes of each tile's cells."""
    step, every = size - 1, mesh_step(size, quality)
    t = cells.where("elev is not null").withColumn("tile_y", F.explode(_shared("row", step))).withColumn("tile_x", F.explode(_shared("col", step)))
    i, j = F.col("col") - F.col("tile_x") * step, F.col("row") - F.col("tile_y") * step
    ends = t.groupBy(*keys, "tile_x", "tile_y").agg(F.min("elev").alias("_low"), F.max("elev").alias("_high"))
    kept = t.where(((i % every == 0) | (i == step)) & ((j % every == 0) | (j == step))).join(ends, [*keys, "tile_x", "tile_y"])
    h = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("elev") - F.col("_low")) * 32767 / (F.col("_high") - F.col("_low")))).otherwise(F.lit(0)).cast("int")
    scale = lambda c: F.floor(c * 32767 / F.lit(step)).cast("int")
    return kept.select(*keys, "tile_x", "tile_y", scale(i).alias("u"), scale(F.lit(step) - j).alias("v"), h.alias("h"))


def children(finer: DataFrame) -> DataFrame:
    """(x, y, children) one zoom up: which quarters have tiles, as bits from the south-west, by rows."""
    bit = F.expr("cast(shiftleft(1, cast((y % 2) * 2 + x % 2 as int)) as int)")
    return finer.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.bit_or(bit).alias("children"))


def heightmap_bytes(tiles: DataFrame, samples: str = "samples", name: str = "body") -> DataFrame:
    """tiles with the body of a heightmap-1.0 file: samples as little-endian 16-bit numbers, the column children (all four
    where there is none), no water."""

    def pack(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index(samples))
            ends = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u2")
            bits = b.column(b.schema.get_field_index("children")).to_pylist() if "children" in b.schema.names else [15] * b.num_rows
            body = [data[x:y].tobytes() + bytes([c or 0, 0]) for x, y, c in zip(ends[:-1], ends[1:], bits, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(body, pa.binary())], names=[*b.schema.names, name])

    return tiles.mapInArrow(pack, T.StructType([*tiles.schema.fields, T.StructField(name, T.BinaryType())]))
