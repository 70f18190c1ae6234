"""The whole way from an elevation file to a published tileset."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orospark.functions.progress import restored_progress, stage_of_status
from orospark.operators import catalog, encode, lineage, progress, raster, tiles
from orospark.plans.options import PreprocessOptions, PublishOptions, TileOptions
from orospark.sources import files, geotiff, sinks

#: Samples on a side of a tile, unless the options say otherwise (heightmaps have no choice).
TILE_SIZE = 65
#: Sample of sea level in a heightmap, where a tile reaches beyond the elevation file.
SEA = 5000


@dataclass(frozen=True)
class Workspace:
    """Folders of a workspace, on any file system that Spark reads: jobs/{id}, and append-only logs of jobs and the catalogue."""

    root: str

    def job(self, job_id: str) -> str:
        return f"{self.root.rstrip('/')}/jobs/{job_id}"

    @property
    def job_log(self) -> str:
        return f"{self.root.rstrip('/')}/logs/jobs"

    @property
    def catalogue(self) -> str:
        return f"{self.root.rstrip('/')}/logs/catalogue"


@dataclass(frozen=True)
class Request:
    input_path: str
    preprocess: PreprocessOptions = field(default_factory=PreprocessOptions)
    tile: TileOptions = field(default_factory=TileOptions)
    publish: PublishOptions = field(default_factory=PublishOptions)


def _mercator(lat: float) -> float:
    return math.log(math.tan(math.radians(45 + lat / 2)))


def _latitude(y: float) -> float:
    return math.degrees(2 * math.atan(math.exp(y))) - 90


@dataclass(frozen=True)
class Grid:
    """Where cells lie: degrees, or with mercator rows that are even in Mercator's y between the first and the last."""

    west: float
    north: float
    dx: float
    dy: float
    rows: int
    cols: int
    mercator: bool = False

    @classmethod
    def of(cls, west: float, north: float, dx: float, dy: float, rows: int, cols: int, crs: str | None) -> Grid:
        """From a file's place. Metres of EPSG:3857 become degrees; a place without a system has to be one in degrees."""
        if crs == "EPSG:3857":
            metre = 180 / (math.pi * 6378137.0)
            first, last = (_latitude((north - dy * (k + 0.5)) / 6378137.0) for k in (0, rows - 1))
            step = (first - last) / (rows - 1) if rows > 1 else _latitude(north / 6378137.0) - _latitude((north - dy) / 6378137.0)
            return cls(west * metre, first + step / 2, dx * metre, step, rows, cols, True)
        east, south = west + dx * cols, north - dy * rows
        if west < -180 - dx or east > 360 + dx or north > 90 + dy or south < -90 - dy:
            raise ValueError(f"the file's bounds ({west}, {south}, {east}, {north}) aren't degrees, and it names no known reference system")
        return cls(west, north, dx, dy, rows, cols)

    @property
    def south(self) -> float:
        return self.north - self.dy * self.rows

    @property
    def ends(self) -> tuple[float, float]:
        """Latitudes of the first and the last row's cells."""
        return self.north - self.dy / 2, self.south + self.dy / 2

    def lon(self) -> Column:
        return F.lit(self.west) + (F.col("col") + 0.5) * self.dx

    def lat(self) -> Column:
        if not self.mercator:
            return F.lit(self.north) - (F.col("row") + 0.5) * self.dy
        top, foot = map(_mercator, self.ends)
        return F.degrees(2 * F.atan(F.exp(F.lit(top) + F.lit(foot - top) * F.col("row") / max(self.rows - 1, 1)))) - 90.0

    def samples(self, zoom: int, size: int) -> tuple[tuple[float, float], tuple[float, float]]:
        """(first, step) of the samples of all tiles of a zoom, in cells: rows from the southmost cell, columns from the westmost."""
        per = size - 1
        wide = (360.0 if self.mercator else 180.0) / (1 << zoom) / per
        cols = ((-180.0 - self.west) / self.dx - 0.5, wide / self.dx)
        if not self.mercator:
            return ((-90.0 - self.south) / self.dy - 0.5, wide / self.dy), cols
        top, foot = map(_mercator, self.ends)
        step = (top - foot) / (self.rows - 1) if self.rows > 1 else math.radians(self.dx)
        return ((-math.pi - foot) / step, 2 * math.pi / (1 << zoom) / per / step), cols


def reproject(cells: DataFrame, grid: Grid, crs: str) -> tuple[DataFrame, Grid]:
    """cells on a grid of the given system, bilinear: rows respaced between even latitudes and even Mercator y, either way."""
    if crs not in ("EPSG:4326", "EPSG:3857"):
        raise ValueError(f"can't bring rows to {crs}")
    if grid.mercator == (crs == "EPSG:3857"):
        return cells, grid
    spark, (first, last) = cells.sparkSession, grid.ends
    if crs == "EPSG:4326":
        return raster.remap_rows(cells, raster.latitude_rows(first, last, grid.rows, spark)), replace(grid, mercator=False)
    limit = tiles.MERCATOR_LIMIT
    if max(abs(grid.north), abs(grid.south)) > limit + grid.dy:
        raise ValueError(f"can't bring rows from {grid.south} to {grid.north} to {crs}")
    return raster.remap_rows(cells, raster.mercator_rows(min(first, limit), max(last, -limit), grid.rows, spark)), replace(grid, mercator=True)


def start_zoom(grid: Grid, options: TileOptions) -> int:
    """As asked, else the deepest at which a tile is no smaller than tile_size (65) cells."""
    if options.start_zoom is not None:
        return options.start_zoom
    return max(0, int(math.floor(math.log2(360.0 / (grid.dx * ((options.tile_size or TILE_SIZE) - 1))))) - (options.profile == "geodetic"))


def tile_cells(cells: DataFrame, grid: Grid, options: TileOptions) -> DataFrame:
    """(z, x, y, n, total, least, most) of all zooms."""
    zoom = start_zoom(grid, options)
    x, y = tiles.tile_xy(grid.lon(), grid.lat(), F.lit(zoom), options.profile)
    return tiles.pyramid(cells.select(F.lit(zoom).alias("z"), x.alias("x"), y.alias("y"), "elev"), options.end_zoom or 0, deepest=zoom)


def _bodies(maps: DataFrame, options: TileOptions, size: int) -> DataFrame:
    if options.output_format == "Terrain":
        return tiles.heightmap_bytes(maps)
    return encode.mesh_bytes(maps, step=tiles.mesh_step(size, options.mesh_qfactor), normals=options.normals, profile=options.profile)


def write_pyramid(cells: DataFrame, grid: Grid, options: TileOptions, stats: DataFrame, job: str) -> None:
    """Tiles with their bodies under {job}/tiles, zoom by zoom from the deepest.

    The deepest zoom's samples are resampled from the cells; each zoom above from the samples of the one below, every second
    of them, so the work falls to a quarter a zoom and the source is read once. (Averages go up by weights 1, 2, 1; the other
    methods as they are.) Samples of a zoom are written before the next one reads them, and deleted at the end. Root tiles that
    are missing are flat, at sea level, if the options ask for them."""
    spark, size = cells.sparkSession, (options.tile_size or TILE_SIZE) if options.output_format == "Mesh" else TILE_SIZE
    cells, grid = reproject(cells, grid, "EPSG:3857" if options.profile == "mercator" else "EPSG:4326")
    deepest, last = start_zoom(grid, options), options.end_zoom or 0
    up = cells.withColumn("row", F.lit(grid.rows - 1) - F.col("row"))
    path, scratch = f"{job}/tiles", f"{job}/samples"
    if not options.resume:
        sinks.delete(spark, path)
    below = raster.resample_onto(up, *grid.samples(deepest, size), options.resampling_method)
    coarser = "bilinear" if options.resampling_method == "average" else options.resampling_method
    for z in range(deepest, last - 1, -1):
        wide, high = (1 << z) * (1 if options.profile == "mercator" else 2) * (size - 1), (1 << z) * (size - 1)
        below.where(F.col("row").between(0, high) & F.col("col").between(0, wide)).write.mode("overwrite").parquet(f"{scratch}/{z}")
        samples = spark.read.parquet(f"{scratch}/{z}")
        own = stats.where(F.col("z") == z).select("x", "y", "n", "total", "least", "most")
        maps = tiles.heightmaps(samples, size, z, missing=SEA, south_up=True).join(own, ["x", "y"])
        kids = tiles.children(stats.where(F.col("z") == z + 1))
        maps = maps.join(kids, ["x", "y"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
        sinks.write_tiles(_bodies(maps, options, size).select("z", "x", "y", "n", "total", "least", "most", "filled", "children", "body"), path, True)
        below = raster.resample_onto(samples, (0.0, 2.0), (0.0, 2.0), coarser)
    if options.cesium_friendly:
        roots = tiles.with_roots(spark.read.parquet(path), options.profile).where("is_added").select("z", "x", "y")
        kids = tiles.children(stats.where("z = 1"))
        flat = roots.join(kids, ["x", "y"], "left").withColumn("children", F.coalesce("children", F.lit(0))).withColumn("samples", F.array_repeat(F.lit(SEA), size * size))
        none = {k: F.lit(None).cast(t) for k, t in stats.dtypes if k in ("total", "least", "most")}
        flat = _bodies(flat.coalesce(1), options, size).withColumns(none | {"n": F.lit(0).cast("long"), "filled": F.lit(0)})
        sinks.write_tiles(flat.select("z", "x", "y", "n", "total", "least", "most", "filled", "children", "body"), path, True)
    sinks.delete(spark, scratch)


def _log(spark: SparkSession, path: str, job_id: str, seq: int, status: str, percent: float, error: str | None = None) -> None:
    """State and percent are one row: nobody sees a finished job at less than 100."""
    row = [(job_id, seq, status, percent, datetime.now(UTC), error)]
    sinks.append_events(spark.createDataFrame(row, "job_id string, seq long, status string, percent double, ts timestamp, error string").coalesce(1), path)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def run(spark: SparkSession, space: Workspace, request: Request, job_id: str | None = None) -> str:
    """Process one elevation file; returns the job's id. The file has to lie in the workspace and exist.

    Besides tiles and descriptor the job has a manifest, {job}/manifest.json: as it was made, and how it ended. A failure is
    logged with the percent of the stage it came in, and raised."""
    job_id = job_id or uuid4().hex
    if not files.is_inside(spark, request.input_path, space.root):
        raise ValueError("the file is outside the workspace")
    if not files.exists(spark, request.input_path):
        raise FileNotFoundError(request.input_path)
    job, percent, seq = space.job(job_id), 0.0, 0

    def stage(status: str, at: float) -> None:
        nonlocal percent, seq
        percent, seq = at, seq + 1
        _log(spark, space.job_log, job_id, seq, status, at)

    asked = json.dumps(asdict(request), sort_keys=True)
    row = spark.createDataFrame([(job_id, request.input_path, f"{job}/tiles", _now(), asked)], "job_id string, input_path string, output_dir string, at string, request string")
    manifest = lineage.created(row)
    _write_manifest(spark, manifest, job)
    try:
        stage("running", 0.0)
        source = files.fingerprints(spark, request.input_path)
        source.withColumn("job_id", F.lit(job_id)).write.mode("overwrite").parquet(f"{job}/source")
        known = spark.read.parquet(f"{job}/source").first()
        whole = F.struct(F.col("source.input_path").alias("input_path"), F.col("source.file_name").alias("file_name"), F.lit(known.size_bytes).alias("size_bytes"), F.lit(known.sha256).alias("sha256"))
        manifest = manifest.withColumn("source", whole).withColumn("status", F.lit("running")).withColumn("updated_at", F.lit(_now()))
        _write_manifest(spark, manifest, job)
        stage("preprocessing", 2.0)
        p, t = request.preprocess, request.tile
        found = geotiff.read_places(spark, request.input_path).drop("raster_id").first()
        grid = Grid.of(**found.asDict())
        cells = geotiff.read_dem(spark, request.input_path).drop("raster_id")
        if p.nodata_value is not None:
            cells = raster.mask_nodata(cells, p.nodata_value)
        cells, grid = reproject(cells, grid, p.target_crs)
        cells, _ = raster.preprocess(cells, fill=p.fill_nodata, build_overviews=False)
        sinks.write_blocks(cells, f"{job}/preprocessed", p.block_size)
        cells = raster.from_blocks(spark.read.parquet(f"{job}/preprocessed"))
        if p.build_overviews:
            every = [d.select(F.lit(f).alias("factor"), "row", "col", "elev") for f, d in raster.overviews(cells).items()]
            out = every[0]
            for d in every[1:]:
                out = out.unionByName(d)
            out.write.partitionBy("factor").mode("overwrite").parquet(f"{job}/overviews")
        stage("tiling", 25.0)
        tile_cells(cells, grid, t).write.mode("overwrite").parquet(f"{job}/statistics")
        stats = spark.read.parquet(f"{job}/statistics")
        if not t.layer_only:
            write_pyramid(cells, grid, t, stats, job)
        addresses = (stats if t.layer_only else spark.read.parquet(f"{job}/tiles")).select("z", "x", "y")
        write_layer(spark, addresses, t, job)
        if request.publish.publishes():
            stage("publishing", 95.0)
            name = publish(spark, space, job_id, request.publish.tileset_name)
        stage("completed", 100.0)
    except Exception as e:
        _log(spark, space.job_log, job_id, seq + 1, "failed", percent, str(e))
        _write_manifest(spark, _ended(manifest, str(e)), job)
        raise
    url, name = (tilesets(spark, space).where(F.col("name") == name).first().terrain_url, name) if request.publish.publishes() else (None, None)
    _write_manifest(spark, _ended(manifest, None, url, name), job)
    return job_id


def _ended(manifest: DataFrame, error: str | None, url: str | None = None, name: str | None = None) -> DataFrame:
    row = [(manifest.first().job_id, _now(), error, url, name)]
    return lineage.finished(manifest, manifest.sparkSession.createDataFrame(row, "job_id string, at string, error string, terrain_url string, tileset_name string"))


def _write_manifest(spark: SparkSession, manifest: DataFrame, job: str) -> None:
    sinks.write_document(spark, f"{job}/manifest.json", manifest.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def manifests(spark: SparkSession, space: Workspace) -> DataFrame:
    """The manifests of all jobs that have a readable one."""
    texts = files.json_texts(spark, f"{space.root.rstrip('/')}/jobs/*/manifest.json")
    return texts.select(lineage.read_manifest(F.col("text")).alias("m")).where("m.job_id is not null").select("m.*")


def write_layer(spark: SparkSession, addresses: DataFrame, options: TileOptions, job: str) -> None:
    """{job}/layer/layer.json of the tiles there are. When work is resumed, or only the descriptor is asked for, one that is readable
    and has anything available stays as it is."""
    extensions = ("octvertexnormals",) if options.normals else ()
    made = tiles.descriptor(tiles.extents(addresses), options.output_format, options.profile, extensions=extensions)
    there = files.json_texts(spark, f"{job}/layer/layer.json").first() if options.resume or options.layer_only else None
    text = made.select(tiles.keep_or_generate(F.lit(there.text if there else None).cast("string"), F.col("layer_json")).alias("t")).first()
    if text is None:
        raise ValueError("no cell of the file lies in any tile")
    sinks.write_document(spark, f"{job}/layer/layer.json", text.t)


def run_all(spark: SparkSession, space: Workspace, requests: list[Request], workers: int = 2) -> list[str | Exception]:
    """Several jobs, ``workers`` at a time, each in a scheduler pool of its own; ids, or what went wrong, in the requests' order."""
    from pyspark import inheritable_thread_target

    def one(k: int) -> str | Exception:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"terrain-{k % workers}")
        try:
            return run(spark, space, requests[k])
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), range(len(requests))))


def export(spark: SparkSession, space: Workspace, job_id: str, folder: str) -> int:
    """A job's tiles as files z/x/y.terrain with layer.json beside them, as servers of tiles expect; returns their number."""
    job = space.job(job_id)
    n = sinks.write_tile_files(spark.read.parquet(f"{job}/tiles"), folder)
    sinks.write_document(spark, f"{folder.rstrip('/')}/layer.json", files.json_texts(spark, f"{job}/layer/layer.json").first().text)
    return n


def publish(spark: SparkSession, space: Workspace, job_id: str | None = None, name: str | None = None, tiles_dir: str | None = None) -> str:
    """Put a job's tiles in the catalogue, or those of a folder of the workspace (with its layer.json); returns the name.

    A job has to be over, or about to publish; a folder has to lie in the workspace and hold tiles."""
    if job_id is not None and tiles_dir is None:
        if catalog.publishable(jobs(spark, space).where(F.col("job_id") == job_id).withColumn("output_dir", F.lit(f"{space.job(job_id)}/tiles"))).isEmpty():
            raise ValueError(f"job {job_id} isn't completed")
        where = f"{space.job(job_id)}/layer/layer.json"
    elif tiles_dir is not None and job_id is None:
        if not files.is_inside(spark, tiles_dir, space.root):
            raise ValueError("the folder is outside the workspace")
        if files.scan_tiles(spark, tiles_dir).isEmpty():
            raise FileNotFoundError(f"no tiles in {tiles_dir}")
        where = f"{tiles_dir.rstrip('/')}/layer.json"
    else:
        raise ValueError("give a job or a folder, one of them")
    text = files.json_texts(spark, where).first()
    if text is None and tiles_dir is None:
        raise FileNotFoundError(f"no tiles of job {job_id}")
    row = [(job_id, tiles_dir, name, None, None, text.text if text else None, datetime.now(UTC))]
    asked = spark.createDataFrame(row, "job_id string, tiles_dir string, tileset_name string, output_format string, profile string, layer_json string, at timestamp")
    events = catalog.publish(asked)
    first = events.first()
    if first.reason:
        raise ValueError(first.reason)
    sinks.append_events(events.drop("reason"), space.catalogue)
    return first.name


def unpublish(spark: SparkSession, space: Workspace, name: str) -> None:
    """Take a name out of the catalogue; its tiles stay."""
    events = spark.read.parquet(space.catalogue)
    there = catalog.published(events).where(F.col("name") == name)
    if there.isEmpty():
        raise FileNotFoundError(f"{name} isn't published")
    sinks.append_events(there.withColumn("published", F.lit(False)).withColumn("at", F.current_timestamp()).select(*events.columns), space.catalogue)


def tilesets(spark: SparkSession, space: Workspace) -> DataFrame:
    """All that is published, by name."""
    if not files.exists(spark, space.catalogue):
        return spark.createDataFrame([], "name string")
    return catalog.listing(catalog.published(spark.read.parquet(space.catalogue)))


def jobs(spark: SparkSession, space: Workspace) -> DataFrame:
    """Current state of all jobs."""
    if not files.exists(spark, space.job_log):
        return spark.createDataFrame([], "job_id string, status string, percent double, ts timestamp, error string")
    return progress.latest(spark.read.parquet(space.job_log), "job_id", F.col("seq"), ["status", "percent", "ts", "error"])


def job(spark: SparkSession, space: Workspace, job_id: str) -> DataFrame:
    """Everything about one job, a row or none: from the log, else from its manifest, else from its tiles."""
    log = jobs(spark, space).where(F.col("job_id") == job_id)
    disk = manifests(spark, space).where(F.col("job_id") == job_id)
    known = lineage.job_from_manifest(disk).drop("from_disk", "status", "stage", "progress", "error", "updated_at")
    shown = F.struct(F.col("percent"), stage_of_status(F.col("status")).alias("phase"), restored_progress(F.col("status"), F.col("error"))["message"].alias("message"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    live = log.select("job_id", "status", stage_of_status(F.col("status")).alias("stage"), at.alias("updated_at"), "error", shown.alias("progress")).join(known, "job_id", "left")
    there = [(job_id, f"{space.job(job_id)}/tiles")] if files.exists(spark, f"{space.job(job_id)}/tiles") else []
    asked = spark.createDataFrame([(job_id,)], "job_id string")
    return lineage.resolve_jobs(asked, live, disk, spark.createDataFrame(there, "job_id string, tiles_dir string"))


def provenance(spark: SparkSession, space: Workspace) -> DataFrame:
    """Which source, and which request, each published tileset was made from."""
    return lineage.provenance(tilesets(spark, space).select("job_id", F.col("name").alias("tileset_name"), "terrain_url", F.col("at").alias("published_at"), "tiles_dir"), manifests(spark, space))
