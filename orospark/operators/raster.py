"""Raster operators over cells: a row for each cell with row, col and elev; a null elev is nodata.

keys name the columns that tell rasters apart. Sums of integer elevations stay exact; every mean is one division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTORS = (2, 4, 8, 16)
FILL_RADIUS = 10
#: Integer taps at half-cell offsets around a block's middle, for even factors.
TAPS = {"bilinear": (1, 1), "cubic": (-1, 9, 9, -1), "cubicspline": (1, 23, 23, 1), "lanczos": (24317, -135095, 607927, 607927, -135095, 24317)}
METHODS = ("nearest", *TAPS, "average", "mode", "max", "min", "med", "q1", "q3")


def cells_from_arrays(df: DataFrame, row: str, values: str, scale: int = 10_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row of cells for each row of df; elev is the floor of value times scale, a long."""
    return df.select(*keys, F.col(row).alias("row"), F.posexplode(values).alias("col", "v")).select(*keys, "row", F.col("col").cast("long").alias("col"), F.floor(F.col("v").cast("double") * scale).cast("long").alias("elev"))


def mask_nodata(cells: DataFrame, nodata) -> DataFrame:
    """A value (or a condition) that stands for nodata becomes null."""
    if isinstance(nodata, Column):
        return cells.withColumn("elev", F.when(~nodata, F.col("elev")))
    return cells.withColumn("elev", F.nullif(F.col("elev"), F.lit(nodata)))


def profile(cells: DataFrame, keys: tuple[str, ...] = (), pad: float = 0.08, least_pad: float = 10.0) -> DataFrame:
    """Counts, extremes and the padded display range of each raster."""
    out = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count("elev").alias("n_valid"), F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"))
    p = F.greatest(F.lit(least_pad), (F.col("max_elev") - F.col("min_elev")) * pad)
    return out.withColumn("shown_min", F.floor(F.col("min_elev") - p).cast("long")).withColumn("shown_max", F.ceil(F.col("max_elev") + p).cast("long"))


def to_blocks(cells: DataFrame, size: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """(block_row, block_col, cells): blocks of at most size x size cells in row order, size a multiple of 16."""
    if size < 16 or size % 16:
        raise ValueError("the block size has to be a multiple of 16")
    at = cells.withColumn("block_row", F.expr(f"row div {size}")).withColumn("block_col", F.expr(f"col div {size}"))
    return at.groupBy(*keys, "block_row", "block_col").agg(F.array_sort(F.collect_list(F.struct("row", "col", "elev"))).alias("cells"))


def from_blocks(blocks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return blocks.select(*keys, F.explode("cells").alias("c")).select(*keys, "c.row", "c.col", "c.elev")


def _block(cells: DataFrame, factor: int) -> DataFrame:
    return cells.withColumn("row", F.expr(f"row div {factor}")).withColumn("col", F.expr(f"col div {factor}"))


def overview_sums(cells: DataFrame, factor: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, total, n) of blocks of factor x factor cells; takes cells, or sums of a finer level."""
    sums = [F.sum("total").alias("total"), F.sum("n").alias("n")] if "total" in cells.columns else [F.sum("elev").alias("total"), F.count("elev").alias("n")]
    return _block(cells, factor).groupBy(*keys, "row", "col").agg(*sums)


def mean_of(sums: DataFrame) -> DataFrame:
    return sums.withColumn("elev", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def overviews(cells: DataFrame, factors: tuple[int, ...] = FACTORS, keys: tuple[str, ...] = ()) -> dict[int, DataFrame]:
    """Mean of each level. A level whose factor is a multiple of the one before is built from its sums, not from the cells."""
    out, last, by = {}, cells, 1
    for f in factors:
        last, by = (overview_sums(last, f // by, keys), f) if f % by == 0 else (overview_sums(cells, f, keys), f)
        out[f] = mean_of(last)
    return out


def _scatter(cells: DataFrame, axis: str, factor: int, taps: tuple[int, ...]) -> DataFrame:
    """Each cell goes to the blocks whose taps reach it, along one axis; total and w are sums of weights so far."""
    half, c = len(taps) // 2, F.col(axis)
    shift = lambda t: c - factor // 2 + half - t
    spots = F.filter(F.array(*[F.when(shift(t) % factor == 0, F.struct(F.floor(shift(t) / factor).cast("long").alias("at"), F.lit(w).cast("long").alias("w"))) for t, w in enumerate(taps)]), lambda x: x.isNotNull())
    return cells.withColumn("_s", F.explode(spots)).withColumn(axis, F.col("_s.at")).withColumn("total", F.col("total") * F.col("_s.w")).withColumn("w", F.col("w") * F.col("_s.w")).drop("_s")


def kernel_resample(cells: DataFrame, factor: int, taps: tuple[int, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean around each block's middle, one axis after the other. Nodata cells and cells outside count for
    nothing; a block has a value where it has cells of its own and its weights add up to more than zero."""
    if factor % 2:
        raise ValueError("the taps lie between cells: the factor has to be even")
    own = _block(cells, factor).select(*keys, "row", "col").distinct()
    flat = cells.where("elev is not null").select(*keys, "row", "col", F.col("elev").alias("total"), F.lit(1).cast("long").alias("w"))
    for axis in ("row", "col"):
        flat = _scatter(flat, axis, factor, taps).groupBy(*keys, "row", "col").agg(F.sum("total").alias("total"), F.sum("w").alias("w"))
    return own.join(flat, [*keys, "row", "col"], "left").withColumn("elev", F.when(F.col("w") > 0, F.col("total") / F.col("w")))


def resample(cells: DataFrame, factor: int, method: str = "average", keys: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, elev) of blocks of factor x factor cells by any of METHODS.

    mode: the least of the commonest values; med, q1, q3: the least value with that share at or below it; nearest:
    the cell nearest to the middle, ties by row and col. Nodata cells are left out (nearest takes the nearest valid)."""
    at = [*keys, "row", "col"]
    if method in TAPS:
        return kernel_resample(cells, factor, TAPS[method], keys).select(*at, "elev")
    if method == "average":
        return mean_of(overview_sums(cells, factor, keys)).select(*at, "elev")
    if method in ("min", "max"):
        return _block(cells, factor).groupBy(*at).agg(getattr(F, method)("elev").alias("elev"))
    if method in ("med", "q1", "q3"):
        share = {"q1": 0.25, "med": 0.5, "q3": 0.75}[method]
        return _block(cells, factor).groupBy(*at).agg(F.expr(f"percentile_disc({share}) within group (order by elev)").cast("long").alias("elev"))
    if method == "mode":
        counts = _block(cells, factor).where("elev is not null").groupBy(*at, "elev").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*at).agg(F.max_by("elev", F.struct("n", -F.col("elev"))).alias("elev"))
    if method == "nearest":
        apart = lambda a: F.pow(2 * F.col(a) + 1 - (2 * F.expr(f"{a} div {factor}") * factor + factor), F.lit(2)).cast("long")
        order = F.struct((apart("row") + apart("col")).alias("d"), F.col("row").alias("r"), F.col("col").alias("c"))
        return _block(cells.withColumn("_o", order), factor).where("elev is not null").groupBy(*at).agg(F.min_by("elev", "_o").alias("elev"))
    raise ValueError(f"no resampling method {method}")


#: Half-widths, in samples, of the kernels of resample_onto().
SUPPORT = {"bilinear": 1.0, "cubic": 2.0, "cubicspline": 2.0, "lanczos": 3.0}


def _kernel(t: Column, method: str) -> Column:
    """Weight at a distance t of up to SUPPORT."""
    if method == "bilinear":
        return 1 - t
    if method == "cubic":
        return F.when(t < 1, (1.5 * t - 2.5) * t * t + 1).otherwise(((-0.5 * t + 2.5) * t - 4) * t + 2)
    if method == "cubicspline":
        return F.when(t < 1, (4 - 6 * t * t + 3 * t * t * t) / 6).otherwise((2 - t) * (2 - t) * (2 - t) / 6)
    x = t * 3.141592653589793
    return F.when(t < 1e-9, F.lit(1.0)).otherwise(3 * F.sin(x) * F.sin(x / 3) / (x * x))


def _reach(cells: DataFrame, axis: str, first: float, step: float, method: str) -> DataFrame:
    """cells once for each sample i of an axis that they reach, samples lying at first + step i in cells; _t is how far off."""
    wide = SUPPORT[method] * max(1.0, step) if method in SUPPORT else max(0.5, step / 2)
    lo, hi = (F.col(axis) - wide - first) / step, (F.col(axis) + wide - first) / step
    spots = F.sequence(F.ceil(lo).cast("long"), F.floor(hi).cast("long"))
    out = cells.where(F.ceil(lo) <= F.floor(hi)).withColumn("_i", F.explode(spots))
    far = F.lit(float(first)) + F.col("_i") * F.lit(float(step)) - F.col(axis)
    # a cell half way between two samples, or a sample half way between two cells, belongs to the lower index
    out = out.withColumn("_t", far).where((F.col("_t") < wide) if method not in SUPPORT else (F.abs("_t") < wide))
    return out.withColumn(axis, F.col("_i")).drop("_i")


def resample_onto(cells: DataFrame, rows: tuple[float, float], cols: tuple[float, float], method: str = "average", keys: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, elev) of samples (i, j), which lie at cell coordinates (first + step i) of rows and cols, by any of METHODS.

    Samples may be denser or sparser than cells. Kernels are widened by the step where that is over one, and go one axis after
    the other, with weights of millionths; the other methods work on the cells nearer to the sample than to the next, or on the
    nearest cell. Each cell is sent to the samples that it reaches: no neighbour is looked up, every aggregate is partial
    before its shuffle. Nodata cells count for nothing; samples that no valid cell reaches don't appear."""
    at, flat = [*keys, "row", "col"], cells.where("elev is not null").select(*keys, "row", "col", "elev")
    if method not in METHODS:
        raise ValueError(f"no resampling method {method}")
    if method in SUPPORT:
        flat = flat.withColumn("w", F.lit(1.0))
        for axis, (first, step) in (("row", rows), ("col", cols)):
            weight = F.round(_kernel(F.abs("_t") / max(1.0, step), method) * 1_000_000)
            near = _reach(flat, axis, first, step, method).withColumn("_w", weight).where("_w <> 0")
            flat = near.groupBy(*at).agg(F.sum(F.col("elev") * F.col("_w")).alias("elev"), F.sum(F.col("w") * F.col("_w")).alias("w"))
        return flat.where("w > 0").select(*at, (F.col("elev") / F.col("w")).alias("elev"))
    near = _reach(flat.withColumn("_r", F.col("row")).withColumn("_c", F.col("col")), "row", *rows, method).withColumn("_d", F.col("_t") * F.col("_t"))
    near = _reach(near.drop("_t"), "col", *cols, method).withColumn("_d", F.col("_d") + F.col("_t") * F.col("_t"))
    if method == "mode":
        counts = near.groupBy(*at, "elev").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*at).agg(F.max_by("elev", F.struct("n", -F.col("elev"))).alias("elev"))
    if method in ("med", "q1", "q3"):
        share = {"q1": 0.25, "med": 0.5, "q3": 0.75}[method]
        return near.groupBy(*at).agg(F.expr(f"percentile_disc({share}) within group (order by elev)").alias("elev"))
    value = F.min_by("elev", F.struct(F.round("_d", 9), "_r", "_c")) if method == "nearest" else {"average": F.avg, "min": F.min, "max": F.max}[method]("elev")
    return near.groupBy(*at).agg(value.alias("elev"))


def fill_nodata(cells: DataFrame, radius: int = FILL_RADIUS, keys: tuple[str, ...] = ()) -> DataFrame:
    """cells with filled: elev, or where it is nodata the mean of the valid cells within radius, weighted by 10^6 div d².

    Cells meet in square buckets a little over the radius wide, so a bucket has a bounded number of cells on either
    side and the join is an equi-join; nothing is compared with cells beyond the next bucket."""
    b = radius + 1
    bucket = lambda a: F.floor(F.col(a) / b).cast("long")
    valid = cells.where("elev is not null").select(*keys, bucket("row").alias("_br"), bucket("col").alias("_bc"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("elev").alias("_v"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    gaps = cells.where("elev is null").select(*keys, "row", "col", F.explode(around).alias("_a")).select(*keys, "row", "col", (bucket("row") + F.col("_a.i")).alias("_br"), (bucket("col") + F.col("_a.j")).alias("_bc"))
    d2 = (F.col("row") - F.col("_r")) * (F.col("row") - F.col("_r")) + (F.col("col") - F.col("_c")) * (F.col("col") - F.col("_c"))
    near = gaps.join(valid, [*keys, "_br", "_bc"]).withColumn("_d2", d2).where(F.col("_d2") <= radius * radius).withColumn("_w", F.expr("1000000 div _d2"))
    sums = near.groupBy(*keys, "row", "col").agg(F.sum(F.col("_w") * F.col("_v")).alias("_t"), F.sum("_w").alias("_s"))
    filled = cells.join(sums, [*keys, "row", "col"], "left")
    return filled.withColumn("filled", F.coalesce(F.col("elev").cast("double"), F.col("_t") / F.col("_s"))).drop("_t", "_s")


def rescale_bilinear(cells: DataFrame, num: int, den: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear sampling at target i -> source i * num / den on both axes, with integer weights.

    A source cell r reaches the targets with |i * num - r * den| < den, by a triangle weight; so each cell is sent
    to its targets, axis by axis, and no neighbour is looked up. Only targets between source cells appear."""
    ends = cells.groupBy(*keys).agg(*[f(a).alias(f"_{n}_{a}") for a in ("row", "col") for n, f in (("min", F.min), ("max", F.max))])
    flat = cells.where("elev is not null").select(*keys, "row", "col", F.col("elev").alias("total"), F.lit(1).cast("long").alias("w"))
    for axis in ("row", "col"):
        first, last = F.floor((F.col(axis) - 1) * den / F.lit(num)).cast("long"), F.ceil((F.col(axis) + 1) * den / F.lit(num)).cast("long")
        flat = flat.withColumn("_i", F.explode(F.sequence(first, last)))
        weight = F.lit(den) - F.abs(F.col("_i") * num - F.col(axis) * den)
        flat = flat.withColumn("_w", weight).where("_w > 0").withColumn(axis, F.col("_i")).withColumn("total", F.col("total") * F.col("_w")).withColumn("w", F.col("w") * F.col("_w"))
        flat = flat.groupBy(*keys, "row", "col").agg(F.sum("total").alias("total"), F.sum("w").alias("w"))
    inside = reduce(Column.__and__, [(F.col(a) * num >= F.col(f"_min_{a}") * den) & (F.col(a) * num <= F.col(f"_max_{a}") * den) for a in ("row", "col")])
    joined = flat.join(F.broadcast(ends), list(keys)) if keys else flat.crossJoin(F.broadcast(ends))  # one row for each raster
    return joined.where(inside).select(*keys, "row", "col", (F.col("total") / F.col("w")).alias("elev"))


def _mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(F.lit(45.0) + lat / 2)))


def _between(place: Column, rows: int, spark) -> DataFrame:
    """(target, source, weight) of rows that lie at a place among source rows: bilinear, weights in millionths."""
    i = F.col("id")
    place = F.least(F.greatest(F.round(place, 9), F.lit(0.0)), F.lit(float(rows - 1)))
    base = F.floor(place).cast("long")
    part = F.floor((place - base) * 1_000_000).cast("long")
    pair = F.array(F.struct(base.alias("source"), (F.lit(1_000_000) - part).alias("weight")), F.struct((base + 1).alias("source"), part.alias("weight")))
    return spark.range(rows).select(i.alias("target"), F.explode(pair).alias("p")).select("target", "p.source", "p.weight").where("weight > 0")


def mercator_rows(north: float, south: float, rows: int, spark) -> DataFrame:
    """(target, source, weight): rows equally spaced in Mercator y, from rows equally spaced in latitude, both between the
    same first and last row. Latitudes have to lie within 85.06 degrees."""
    top, foot = _mercator_y(F.lit(north)), _mercator_y(F.lit(south))
    at = top + (foot - top) * F.col("id") / F.lit(max(rows - 1, 1))
    lat = F.degrees(F.lit(2.0) * F.atan(F.exp(at))) - 90.0
    return _between((F.lit(north) - lat) / F.lit((north - south) / max(rows - 1, 1)), rows, spark)


def latitude_rows(north: float, south: float, rows: int, spark) -> DataFrame:
    """(target, source, weight) the other way: rows equally spaced in latitude, from rows equally spaced in Mercator y."""
    top, foot = _mercator_y(F.lit(north)), _mercator_y(F.lit(south))
    lat = F.lit(north) + F.lit(south - north) * F.col("id") / F.lit(max(rows - 1, 1))
    return _between((_mercator_y(lat) - top) / (foot - top) * F.lit(max(rows - 1, 1)), rows, spark)


def remap_rows(cells: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cells resampled along rows by a table like that of mercator_rows: one equi-join, one aggregate."""
    joined = cells.where("elev is not null").join(rows.withColumnRenamed("source", "row"), "row")
    sums = joined.groupBy(*keys, F.col("target").alias("row"), "col").agg(F.sum(F.col("elev") * F.col("weight")).alias("t"), F.sum("weight").alias("w"))
    return sums.select(*keys, "row", "col", (F.col("t") / F.col("w")).alias("elev"))


def gradients(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cells with gx and gy, differences of the neighbours on either side; null where one is missing or nodata."""
    out = cells
    for name, axis, other in (("gx", "col", "row"), ("gy", "row", "col")):
        w = Window.partitionBy(*keys, other).orderBy(axis)
        step = lambda f, axis=axis, w=w: F.when(F.abs(f(axis).over(w) - F.col(axis)) == 1, f("elev").over(w))
        out = out.withColumn(name, step(F.lead) - step(F.lag))
    return out


def slope_aspect(cells: DataFrame, cell_size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """slope in degrees, and aspect: the compass direction that it faces, null on the flat."""
    g = gradients(cells, keys)
    x, y = F.col("gx") / (2 * cell_size), F.col("gy") / (2 * cell_size)
    aspect = F.pmod(F.degrees(F.atan2(-x, y)), F.lit(360.0))
    return g.withColumn("slope", F.degrees(F.atan(F.sqrt(x * x + y * y)))).withColumn("aspect", F.when((F.col("gx") != 0) | (F.col("gy") != 0), aspect))


def normals(cells: DataFrame, cell_size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unit normal (nx, ny, nz) of each cell that has both gradients."""
    g = gradients(cells, keys).where("gx is not null and gy is not null")
    x, y = F.col("gx") / (2 * cell_size), F.col("gy") / (2 * cell_size)
    n = F.sqrt(x * x + y * y + 1)
    return g.withColumn("nx", -x / n).withColumn("ny", -y / n).withColumn("nz", F.lit(1.0) / n)


def contours(cells: DataFrame, spacing: int = 150, width: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """cells with contour: whether a contour runs between the cell and the next in its row or column; lines of a greater width
    also take the width - 1 cells after it."""
    if spacing < 1 or not 1 <= width <= 8:
        raise ValueError("spacing is at least 1, width 1 to 8")
    band = F.floor(F.col("elev") / spacing)
    out, on = cells.withColumn("_b", band), F.lit(False)
    for axis, other in (("col", "row"), ("row", "col")):
        w = Window.partitionBy(*keys, other).orderBy(axis)
        crossed = F.when(F.lead(axis).over(w) - F.col(axis) == 1, F.lead("_b").over(w)) != F.col("_b")
        out = out.withColumn(f"_{axis}", F.coalesce(crossed, F.lit(False)))
        on = on | F.max(f"_{axis}").over(w.rangeBetween(1 - width, 0))
    return out.withColumn("contour", on).drop("_b", "_col", "_row")


def sample_grid(cells: DataFrame, n: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, row, col, elev): (n + 1)² places spread evenly over each raster's rectangle, with the cell at each.

    One row for each raster is exploded to its places, then met with the cells by an equi-join."""
    ends = cells.groupBy(*keys).agg(*[f(a).alias(f"{n_}_{a}") for a in ("row", "col") for n_, f in (("a", F.min), ("b", F.max))])
    spots = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n))))
    at = lambda axis, k: F.expr(f"a_{axis} + ((b_{axis} - a_{axis}) * {k}) div {n}")
    return spots.select(*keys, "i", "j", at("row", "i").alias("row"), at("col", "j").alias("col")).join(cells, [*keys, "row", "col"])


def preprocess(cells: DataFrame, nodata=None, num: int = 1, den: int = 1, fill: bool = True, build_overviews: bool = True, keys: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Nodata, reprojection, filling and overviews, in this order; all lazy. Filling has to come before tiling."""
    out = cells if nodata is None else mask_nodata(cells, nodata)
    if (num, den) != (1, 1):
        out = rescale_bilinear(out, num, den, keys)
    if fill:
        out = fill_nodata(out, keys=keys).withColumn("elev", F.col("filled")).drop("filled")
    return out, overviews(out, keys=keys) if build_overviews else {}
