"""Queries over the driver's tables, each with an independent DuckDB statement where SQL can say the same.

The tables stand in for terrain objects: embeddings is a grid of elevations, lineitem scattered soundings, events the
log of jobs (job user_id, stage event_type, percent value), customer and orders jobs and what came of them."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orospark.functions import display, labels, progress
from orospark.operators import catalog, lineage, raster, tiles
from orospark.operators import progress as jobs
from orospark.sources.files import entries, table, tile_addresses

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01T00:00:00"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# grids


def dem(spark, d) -> DataFrame:
    return raster.cells_from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")


def gappy(spark, d) -> DataFrame:
    return raster.mask_nodata(dem(spark, d), (F.col("row") * 7 + F.col("col") * 3) % 11 == 0)


DEM = """dem as (select r, c, floor(v::double * 10000)::bigint as e from
  (select vec_id as r, unnest(range(len(embedding))) as c, unnest(embedding) as v from embeddings))"""
GAPPY = DEM + """,
gappy as (select r, c, case when (r * 7 + c * 3) % 11 = 0 then null else e end as e from dem)"""


@query(f'with {DEM} select count(*) as n_cells, count(e) as n_valid, min(e) as min_elev, max(e) as max_elev, floor(min(e) - greatest(10.0, (max(e) - min(e)) * 0.08::double))::bigint as shown_min, ceil(max(e) + greatest(10.0, (max(e) - min(e)) * 0.08::double))::bigint as shown_max from dem')
def raster_profile(spark, d):
    return raster.profile(dem(spark, d))


@query(f'with {GAPPY} select r as "row", c as "col", e as elev from gappy')
def nodata_mask(spark, d):
    return gappy(spark, d)


@query(f'with {DEM} select r // 16 as block_row, c // 16 as block_col, count(*) as n, sum(e)::bigint as total, min(r * 64 + c) as first from dem group by all')
def raster_blocks(spark, d):
    b = raster.to_blocks(dem(spark, d), 16)
    return b.select("block_row", "block_col", F.size("cells").cast("long").alias("n"), F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["elev"]).alias("total"), (F.col("cells")[0]["row"] * 64 + F.col("cells")[0]["col"]).alias("first"))


@query(f"""with {GAPPY}, w as (select g.r, g.c, 1000000 // ((g.r - v.r) * (g.r - v.r) + (g.c - v.c) * (g.c - v.c)) as w, v.e
  from gappy g join gappy v on v.r between g.r - 10 and g.r + 10 and v.c between g.c - 10 and g.c + 10
  where g.e is null and v.e is not null and (g.r - v.r) * (g.r - v.r) + (g.c - v.c) * (g.c - v.c) <= 100),
s as (select r, c, sum(w * e)::bigint as t, sum(w)::bigint as s from w group by all)
select r as "row", c as "col", e as elev, coalesce(e::double, t::double / s) as filled from gappy left join s using (r, c)""")
def fill_nodata_idw(spark, d):
    return raster.fill_nodata(gappy(spark, d))


@query(f"""with {GAPPY}, ends as (select max(r) as mr, max(c) as mc from gappy),
t as (select i, j from ends, unnest(range(mr * 3 // 2 + 1)) x(i), unnest(range(mc * 3 // 2 + 1)) y(j)),
k as (select i, j, i * 2 // 3 + a as r, j * 2 // 3 + b as c, (case when a = 0 then 3 - i * 2 % 3 else i * 2 % 3 end) * (case when b = 0 then 3 - j * 2 % 3 else j * 2 % 3 end) as w
  from t, (values (0), (1)) u(a), (values (0), (1)) v(b))
select i as "row", j as "col", sum(w * e)::bigint::double / sum(w)::bigint as elev from k join gappy using (r, c) where w > 0 and e is not null group by all""")
def rescale_bilinear(spark, d):
    return raster.rescale_bilinear(gappy(spark, d), 2, 3)


def _overview(f: int):
    sql = f"""with {GAPPY} select r // {f} as "row", c // {f} as "col", sum(e)::bigint as total, count(e) as n, case when count(e) > 0 then sum(e)::bigint::double / count(e) end as elev from gappy group by all"""

    @query(sql, f"overview_{f}")
    def overview(spark, d):
        return raster.overviews(gappy(spark, d))[f]


for _f in raster.FACTORS:
    _overview(_f)

_GROUPED = 'with {g} select r // 4 as "row", c // 4 as "col", {x} as elev from gappy group by all'
_RESAMPLE = {
    "average": _GROUPED.format(g=GAPPY, x="case when count(e) > 0 then sum(e)::bigint::double / count(e) end"),
    "min": _GROUPED.format(g=GAPPY, x="min(e)"),
    "max": _GROUPED.format(g=GAPPY, x="max(e)"),
    "med": _GROUPED.format(g=GAPPY, x="quantile_disc(e, 0.5)"),
    "q1": _GROUPED.format(g=GAPPY, x="quantile_disc(e, 0.25)"),
    "q3": _GROUPED.format(g=GAPPY, x="quantile_disc(e, 0.75)"),
    "mode": f"""with {GAPPY}, n as (select r // 4 as r, c // 4 as c, e, count(*) as n from gappy where e is not null group by all)
select r as "row", c as "col", e as elev from (select *, row_number() over (partition by r, c order by n desc, e) as k from n) where k = 1""",
    "nearest": f"""with {GAPPY}, o as (select r // 4 as br, c // 4 as bc, e, row_number() over (partition by r // 4, c // 4 order by
  (2 * (r % 4) - 3) * (2 * (r % 4) - 3) + (2 * (c % 4) - 3) * (2 * (c % 4) - 3), r, c) as k from gappy where e is not null)
select br as "row", bc as "col", e as elev from o where k = 1""",
}


def _kernel_sql(taps: tuple[int, ...]) -> str:
    half, values = len(taps) // 2, ", ".join(f"({k}, {w})" for k, w in enumerate(taps))
    return f"""with {GAPPY}, taps(t, w) as (values {values}), own as (select distinct r // 4 as br, c // 4 as bc from gappy),
k as (select br, bc, br * 4 + 2 - {half} + a.t as r, bc * 4 + 2 - {half} + b.t as c, (a.w::bigint * b.w) as w from own, taps a, taps b),
s as (select br, bc, sum(k.w * e)::bigint as t, sum(k.w)::bigint as w from k join gappy using (r, c) where e is not null group by all)
select br as "row", bc as "col", case when w > 0 then t::double / w end as elev from own left join s using (br, bc)"""


def _resampled(method: str, sql: str):
    @query(sql, f"tile_resample_{method}")
    def resampled(spark, d):
        return raster.resample(gappy(spark, d), 4, method)


for _m, _sql in (_RESAMPLE | {m: _kernel_sql(t) for m, t in raster.TAPS.items()}).items():
    _resampled(_m, _sql)

_GRADIENTS = GAPPY + """,
g as (select a.r, a.c, a.e, l.e as le, rr.e as re, u.e as ue, dn.e as de from gappy a
  left join gappy l on l.r = a.r and l.c = a.c - 1 left join gappy rr on rr.r = a.r and rr.c = a.c + 1
  left join gappy u on u.c = a.c and u.r = a.r - 1 left join gappy dn on dn.c = a.c and dn.r = a.r + 1),
xy as (select r, c, re - le as gx, de - ue as gy, (re - le)::double / 200 as x, (de - ue)::double / 200 as y from g)"""


@query(f"""with {_GRADIENTS} select r as "row", c as "col", gx, gy, round(degrees(atan(sqrt(x * x + y * y))), 4) as slope,
round(case when gx <> 0 or gy <> 0 then case when degrees(atan2(-x, y)) < 0 then degrees(atan2(-x, y)) + 360 else degrees(atan2(-x, y)) end end, 4) as aspect from xy""")
def slope_aspect(spark, d):
    s = raster.slope_aspect(gappy(spark, d), 100.0)
    return s.select("row", "col", "gx", "gy", F.round("slope", 4).alias("slope"), F.round("aspect", 4).alias("aspect"))


@query(f"""with {_GRADIENTS} select r as "row", c as "col", round(-x / sqrt(x * x + y * y + 1), 5) + 0.0 as nx, round(-y / sqrt(x * x + y * y + 1), 5) + 0.0 as ny, round(1.0::double / sqrt(x * x + y * y + 1), 5) as nz from xy where gx is not null and gy is not null""")
def vertex_normals(spark, d):
    n = raster.normals(gappy(spark, d), 100.0)
    return n.select("row", "col", *[(F.round(k, 5) + 0.0).alias(k) for k in ("nx", "ny")], F.round("nz", 5).alias("nz"))


@query(f"""with {GAPPY}, b as (select r, c, floor(e::double / 150) as b from gappy)
select a.r as "row", a.c as "col", coalesce(x.b <> a.b, false) or coalesce(y.b <> a.b, false) as contour from b a
left join b x on x.r = a.r and x.c = a.c + 1 left join b y on y.c = a.c and y.r = a.r + 1""")
def contour_cells(spark, d):
    return raster.contours(gappy(spark, d), 150).select("row", "col", "contour")


def _ramp_sql(ramp: str) -> str:
    out = ""
    for (a, x), (b, y) in pairwise(display.RAMPS[ramp]):
        part = f"(((s + 0.5::double) / 256 - {a}::double) / ({b - a!r})::double)"
        hexes = " || ".join(f"format('{{:02x}}', floor({int(x[k : k + 2], 16)} + {part} * {int(y[k : k + 2], 16) - int(x[k : k + 2], 16)} + 0.5)::int)" for k in (0, 2, 4))
        out += f" when (s + 0.5::double) / 256 <= {b}::double then '#' || {hexes}"
    return f"case{out} end"


@query(f"""with {DEM}, s as (select greatest(0, least(255, floor((e + 500.0::double) * 256 / 3500)))::int as s from dem)
select s as step, {_ramp_sql("hypsometric")} as colour, count(*) as n from s group by all""")
def elevation_ramp(spark, d):
    step = display.ramp_step(F.col("elev"), F.lit(display.MIN_HEIGHT), F.lit(display.MAX_HEIGHT))
    return dem(spark, d).select(step.alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n")).withColumn("colour", display.ramp_colour(F.col("step")))


@query(f"""with {DEM}, m as (select min(r) as ar, max(r) as br, min(c) as ac, max(c) as bc from dem)
select i::int as i, j::int as j, r as "row", c as "col", e as elev from m, range(11) x(i), range(11) y(j) join dem on r = ar + ((br - ar) * i) // 10 and c = ac + ((bc - ac) * j) // 10""")
def elevation_sample_grid(spark, d):
    return raster.sample_grid(dem(spark, d))


_SAMPLES = GAPPY + """, ends as (select max(r) as mr, max(c) as mc from gappy),
t as (select i, j, 0.25::double + 1.5::double * i as y, -0.5::double + 2.0::double * j as x from ends, unnest(range(-2, mr::bigint + 3)) u(i), unnest(range(-2, mc::bigint + 3)) v(j))"""


@query(f"""with {_SAMPLES} select i as "row", j as "col", round(avg(e), 6) as elev from t join gappy on y - r >= -0.75 and y - r < 0.75 and x - c >= -1 and x - c < 1 where e is not null group by all""")
def samples_average(spark, d):
    s = raster.resample_onto(gappy(spark, d), (0.25, 1.5), (-0.5, 2.0), "average")
    return s.select("row", "col", F.round("elev", 6).alias("elev"))


@query(f"""with {_SAMPLES}, k as (select i, j, e, floor((1 - abs(y - r) / 1.5) * 1000000 + 0.5) as a, floor((1 - abs(x - c) / 2) * 1000000 + 0.5) as b from t join gappy on abs(y - r) < 1.5 and abs(x - c) < 2 where e is not null)
select i as "row", j as "col", round(sum(a * b * e) / sum(a * b), 8) as elev from k where a > 0 and b > 0 group by all""")
def samples_bilinear(spark, d):
    s = raster.resample_onto(gappy(spark, d), (0.25, 1.5), (-0.5, 2.0), "bilinear")
    return s.select("row", "col", F.round("elev", 8).alias("elev"))


#: Columns of the grid as rows from 60 degrees north to the equator.
TURNED = "g as (select c as r, r as c, e from gappy)"


def _turned(spark, d) -> DataFrame:
    return gappy(spark, d).select(F.col("col").alias("row"), F.col("row").alias("col"), "elev")


def _remap_sql(place: str) -> str:
    return f"""with {GAPPY}, {TURNED}, m as (select ln(tan(radians(75.0::double))) as top, ln(tan(radians(45.0::double))) as foot),
p as (select i, least(63.0::double, greatest(0.0::double, round({place}, 9))) as p from m, unnest(range(64)) u(i)), b as (select i, floor(p)::bigint as s, floor((p - floor(p)) * 1000000)::bigint as w from p),
k as (select i, s, 1000000 - w as w from b union all select i, s + 1, w from b)
select i as "row", c as "col", round(sum(e * w)::double / sum(w), 6) as elev from k join g on g.r = k.s where w > 0 and e is not null group by all"""


@query(_remap_sql("(60.0::double - (degrees(2 * atan(exp(top + (foot - top) * i / 63))) - 90)) / (60.0::double / 63)"))
def reproject_mercator(spark, d):
    rows = raster.remap_rows(_turned(spark, d), raster.mercator_rows(60.0, 0.0, 64, spark))
    return rows.select("row", "col", F.round("elev", 6).alias("elev"))


@query(_remap_sql("(ln(tan(radians(45.0::double + (60.0::double - 60.0::double * i / 63) / 2))) - top) / (foot - top) * 63"))
def reproject_geographic(spark, d):
    rows = raster.remap_rows(_turned(spark, d), raster.latitude_rows(60.0, 0.0, 64, spark))
    return rows.select("row", "col", F.round("elev", 6).alias("elev"))


# tiles

DEEPEST = 8
SOUNDINGS = f"""s as (select l_returnflag, l_partkey % 360 as lon, l_suppkey % 180 as lat, round(l_extendedprice * 100)::bigint as elev from lineitem),
t as (select l_returnflag, z::int as z, (lon * (2 << z)) // 360 as x, (lat * (1 << z)) // 180 as y, elev from s, unnest(range({DEEPEST + 1})) u(z))"""


def soundings(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 360).alias("lon"), (F.col("l_suppkey") % 180).alias("lat"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("elev"))
    x, y = tiles.whole_degree_tiles(F.col("lon"), F.col("lat"), DEEPEST)
    return t.select("l_returnflag", F.lit(DEEPEST).alias("z"), x.alias("x"), y.alias("y"), "elev")


@query(f'with {SOUNDINGS} select z, min(x) as "startX", min(y) as "startY", max(x) as "endX", max(y) as "endY" from t group by z')
def tile_extents(spark, d):
    return tiles.pyramid_extents(soundings(spark, d))


@query(f"with {SOUNDINGS} select z, x, y, count(elev) as n, sum(elev)::bigint as total, min(elev) as least, max(elev) as most from t group by all")
def tile_pyramid(spark, d):
    return tiles.pyramid(soundings(spark, d), deepest=DEEPEST)


@query(f"""with {SOUNDINGS}, b as (select z, min(x) as sx, min(y) as sy, max(x) as ex, max(y) as ey from t where z not in (1, 3) group by z)
select q.z::int as z, sx as "startX", sy as "startY", ex as "endX", ey as "endY", sx is null as is_empty from unnest(range({DEEPEST + 1})) q(z) left join b on b.z = q.z""")
def layer_available(spark, d):
    return tiles.available_levels(tiles.pyramid_extents(soundings(spark, d)).where("z not in (1, 3)"))


_KEPT = "(z % 2 = 0 or l_returnflag = 'R') and z >= case l_returnflag when 'A' then 2 else 0 end"


@query(f"with {SOUNDINGS} select l_returnflag, min(z) as min_zoom, max(z) as max_zoom from t where {_KEPT} group by all")
def layer_zoom_range(spark, d):
    keys = ("l_returnflag",)
    boxes = tiles.pyramid_extents(soundings(spark, d), keys=keys).where(_KEPT)
    return tiles.available(boxes, keys).withColumn("_z", tiles.zoom_range(F.col("available"))).select("l_returnflag", "_z.min_zoom", "_z.max_zoom")


@query(f"""with {SOUNDINGS}, b as (select z, min(x) as sx, min(y) as sy, max(x) as ex, max(y) as ey from t group by z)
select z, -180.0::double + sx * (360.0::double / (2 << z)) as west, -90.0::double + sy * (180.0::double / (1 << z)) as south, -180.0::double + (ex + 1) * (360.0::double / (2 << z)) as east, -90.0::double + (ey + 1) * (180.0::double / (1 << z)) as north from b""")
def tile_rectangles(spark, d):
    b = tile_extents(spark, d)
    return b.withColumn("_r", display.tile_rectangle(*[F.col(c) for c in ("z", "startX", "startY", "endX", "endY")])).select("z", "_r.*")


@query(f"""with {SOUNDINGS}, m as (select l_returnflag, max(z) as z from t where {_KEPT} group by all)
select l_returnflag, z, min(x)::int as start_x, max(y)::int as end_y from t join m using (l_returnflag, z) group by all""")
def tile_coverage(spark, d):
    keys = ("l_returnflag",)
    layers = tiles.available(tiles.pyramid_extents(soundings(spark, d), keys=keys).where(_KEPT), keys)
    layers = layers.withColumn("projection", F.lit("epsg:4326")).withColumn("bounds", F.array(*[F.lit(0.0)] * 4))
    return tiles.coverage(layers).select("l_returnflag", F.col("cover.z").alias("z"), F.col("cover.box.startX").alias("start_x"), F.col("cover.box.endY").alias("end_y"))


@query(f"""with {SOUNDINGS}, u as (select distinct z, x, y from t), g as (select *, x - row_number() over (partition by z, y order by x) as g from u)
select z, min(x) as "startX", y as "startY", max(x) as "endX", y as "endY" from g group by z, y, g""")
def tile_runs(spark, d):
    return tiles.runs(tiles.pyramid(soundings(spark, d), deepest=DEEPEST))


@query(f"with {SOUNDINGS} select distinct z, x, y from t where (z, x, y) not in (select (z, x, y) from t where l_returnflag = 'R')")
def tile_resume_antijoin(spark, d):
    keys = ("l_returnflag",)
    every = tiles.pyramid(soundings(spark, d), keys=keys, deepest=DEEPEST)
    return tiles.missing_tiles(every.select("z", "x", "y").distinct(), every.where("l_returnflag = 'R'"))


@query(f"""with {SOUNDINGS}, u as (select distinct z, x, y from t where x > 0) select z, x, y, false as is_added from u
union all select 0, x, 0, true from unnest(range(2)) r(x) where (0, x, 0) not in (select (z, x, y) from u)""")
def root_tiles(spark, d):
    return tiles.with_roots(tiles.pyramid(soundings(spark, d), deepest=DEEPEST).where("x > 0"))


@query(f"""with {GAPPY}, t as (select *, unnest(case when r % 16 = 0 and r > 0 then [r // 16, r // 16 - 1] else [r // 16] end) as y from gappy),
u as (select *, unnest(case when c % 16 = 0 and c > 0 then [c // 16, c // 16 - 1] else [c // 16] end) as x from t)
select 3 as z, x, y, count(e)::int as filled, sum(case when e is null then 0 else least(65535, greatest(0, floor((e + 1000) * 5))) end)::bigint as total from u group by all""")
def tile_heightmaps(spark, d):
    h = tiles.heightmaps(gappy(spark, d), 17, 3)
    return h.select("z", "x", "y", "filled", F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"""with {GAPPY}, n as (select max(r) // 16 as my, max(c) // 16 as mx from gappy), t as (select x as tile_x, y as tile_y from n, unnest(range(mx + 1)) u(x), unnest(range(my + 1)) v(y)),
m as (select tile_x, tile_y, c - tile_x * 16 as i, r - tile_y * 16 as j, e from t join gappy on c between tile_x * 16 and tile_x * 16 + 16 and r between tile_y * 16 and tile_y * 16 + 16 where e is not null),
ends as (select tile_x, tile_y, min(e) as lo, max(e) as hi from m group by all)
select tile_x, tile_y, (i * 32767 // 16)::int as u, ((16 - j) * 32767 // 16)::int as v, (case when hi > lo then floor((e - lo)::double * 32767 / (hi - lo)) else 0 end)::int as h from m join ends using (tile_x, tile_y) where i % 2 = 0 and j % 2 = 0""")
def mesh_vertices(spark, d):
    return tiles.mesh_vertices(gappy(spark, d), 17, 2.5)


# labels, names and the catalogue

_FORMATS = ("heightmap-1.0", " Quantized-Mesh-1.0", "quantized-mesh-1.0", "other", "")
_CODES = ("epsg:4326", "WGS84 ", "EPSG:900913", "EPSG:2154", "")


def _choice(values, key: str):
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(F.col(key) % (len(values) + 1) == k, F.lit(v)).otherwise(out)
    return out


def _choice_sql(values, key: str) -> str:
    return f"case {key} % {len(values) + 1} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


@query(f"""with o as (select {_choice_sql(_FORMATS, "o_orderkey")} as f, {_choice_sql(_CODES, "o_custkey")} as p from orders)
select f as format, p as projection, case when lower(trim(f)) like 'quantized-mesh%' then '{labels.MESH_LABEL}' when lower(trim(f)) like 'heightmap%' then '{labels.HEIGHTMAP_LABEL}' when f <> '' then f end as format_label,
case when upper(trim(p)) in ('EPSG:4326', 'WGS84') then '{labels.GEODETIC_LABEL}' when upper(trim(p)) in ('EPSG:3857', 'EPSG:900913') then '{labels.MERCATOR_LABEL}' when p <> '' then p end as crs,
case lower(trim(f)) when 'heightmap-1.0' then 'Terrain' when 'quantized-mesh-1.0' then 'Mesh' else 'Mesh' end as output_format,
case when upper(trim(p)) in ('EPSG:3857', 'EPSG:900913') then 'mercator' else 'geodetic' end as profile, count(*) as n from o group by all""")
def layer_metadata_labels(spark, d):
    o = table(spark, d, "orders").select(_choice(_FORMATS, "o_orderkey").alias("format"), _choice(_CODES, "o_custkey").alias("projection"))
    f, p, none = F.col("format"), F.col("projection"), F.lit(None).cast("string")
    o = o.groupBy("format", "projection").agg(F.count(F.lit(1)).alias("n"))
    return o.select("format", "projection", labels.format_label(f).alias("format_label"), labels.crs_label(p).alias("crs"), labels.publish_choice(none, labels.format_hint(f), "Mesh").alias("output_format"), labels.publish_choice(none, labels.profile_hint(p), "geodetic").alias("profile"), "n")


_NAMES = ("../evil", "string", " coast ", "a/b", ".hidden", ".", "UUID", "", "north..south", "ok-1")


@query(f"""with c as (select c_custkey, c_custkey::varchar as j, {_choice_sql(_NAMES, "c_custkey")} as n from customer),
r as (select c_custkey, case when n is null or trim(n) = '' or lower(trim(n)) in ('string', 'example', 'uuid', 'name') then j else trim(n) end as name from c),
k as (select c_custkey, case when not (name = '' or contains(name, '/') or contains(name, '\\') or contains(name, '..') or name like '.%') then name end as name from r)
select c_custkey, name, 'http://localhost:8103/tilesets/' || name as terrain_url from k""")
def tileset_names(spark, d):
    name = labels.tileset_name(F.col("c_custkey").cast("string"), _choice(_NAMES, "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", name.alias("name"), labels.terrain_url(F.lit("http://localhost:8103/"), F.lit("/tilesets/"), name).alias("terrain_url"))


@query("""with e as (select 'set-' || (user_id % 40) as name, event_id, event_type <> 'error' and event_id % 7 <> 0 as published, user_id from events),
l as (select name, arg_max(published, event_id) as p, arg_max(user_id, event_id) as job_id, max(event_id) as "at" from e group by name) select name, job_id, "at" from l where p""")
def tileset_catalog(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("set-"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("event_id").alias("at"), ((F.col("event_type") != "error") & (F.col("event_id") % 7 != 0)).alias("published"), F.col("user_id").alias("job_id"))
    return catalog.listing(catalog.published(e)).select("name", "job_id", "at")


_DESCRIPTORS = ('{"format":"heightmap-1.0","projection":"EPSG:3857","available":[[],[{"startX":0,"startY":0,"endX":1,"endY":1}],[]]}', "not json", "[]", '{"format":"quantized-mesh-1.0"}')


@query(f"""with c as (select c_custkey as k, case when c_custkey % 3 <> 1 then 'job-' || c_custkey end as j, case c_custkey % 3 when 1 then '/data/jobs/J' || c_custkey || '/tiles/' when 2 then '/data/other' end as t, {_choice_sql(_DESCRIPTORS, "c_custkey")} as l from customer)
select coalesce(j, 'J' || k) as job_id, case when j is not null and t is not null then null else coalesce(j, 'J' || k) end as name,
case when j is not null and t is not null then 'give a job or a folder, not both' end as reason,
case when k % 5 = 0 then 'Terrain' else 'Mesh' end as output_format, case when k % 5 = 0 then 'mercator' else 'geodetic' end as profile, (case when k % 5 = 0 then 1 end)::int as min_zoom from c""")
def publish_requests(spark, d):
    k = F.col("c_custkey")
    r = table(spark, d, "customer").select(
        F.when(k % 3 != 1, F.concat(F.lit("job-"), k)).alias("job_id"), F.when(k % 3 == 1, F.concat(F.lit("/data/jobs/J"), k, F.lit("/tiles/"))).when(k % 3 == 2, F.lit("/data/other")).alias("tiles_dir"), F.lit(None).cast("string").alias("tileset_name"),
        F.lit(None).cast("string").alias("output_format"), F.lit(None).cast("string").alias("profile"), _choice(_DESCRIPTORS, "c_custkey").alias("layer_json"), k.alias("at"),
    )
    return catalog.publish(r).select("job_id", "name", "reason", "output_format", "profile", "min_zoom")


_FILES = ("a.tif", "B.TIFF", "c.dem", "d.IMG", "e.txt", ".tif", "jobs", "folder", "uploads", "x.tar.tif")


@query(f"""with n as (select distinct c_custkey % 11 as k, {_choice_sql(_FILES, "c_custkey")} as name, c_custkey % 2 = 0 as is_dir from customer),
e as (select name, case when is_dir then case when name not in ('jobs', 'uploads', 'tilesets') then 'directory' end when regexp_matches(lower(name), '^.+[.](tif|tiff|dem|img)$') then 'file' end as entry_type from n where name is not null)
select name, name as relative_path, '/w/' || name as absolute_path, entry_type, entry_type = 'file' as selectable from e where entry_type is not null""")
def workspace_listing(spark, d):
    k = F.col("c_custkey")
    n = table(spark, d, "customer").select(_choice(_FILES, "c_custkey").alias("name"), (k % 2 == 0).alias("is_dir")).distinct().where("name is not null")
    return entries(n, "", "/w")


@query("select url as input_path, split_part(url, '/', -1) as file_name, strlen(html)::bigint as size_bytes, sha256(html) as sha256 from pages")
def source_fingerprint(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("input_path"), labels.base_name(F.col("url")).alias("file_name"), F.octet_length("html").cast("long").alias("size_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


# progress


@query("""select b as bucket, s as stage, a as "start", e as "end" from (values ('with_publish', 'initializing', 0.0::double, 2.0::double), ('with_publish', 'gdal_preprocess', 2.0, 25.0), ('with_publish', 'ctb_tile', 25.0, 95.0), ('with_publish', 'register_tileset', 95.0, 100.0),
('without_publish', 'initializing', 0.0, 2.0), ('without_publish', 'gdal_preprocess', 2.0, 25.0), ('without_publish', 'ctb_tile', 25.0, 100.0)) v(b, s, a, e)""")
def stage_ranges(spark, d):
    rows = [(b, k, s, w) for b, x in jobs.DEFAULT_WEIGHTS.items() for k, (s, w) in enumerate(x.items())]
    w = jobs.normalise(spark.createDataFrame(rows, "bucket string, k int, stage string, weight double"), "bucket")
    return jobs.stage_ranges(w, "bucket", "k").select("bucket", "stage", "start", "end")


_STAGES = """o as (select user_id, event_type, ts, event_id, lag(event_type) over w as p from events window w as (partition by user_id order by ts, event_id)),
f as (select *, lead(ts) over (partition by user_id order by ts, event_id) as nx from o where p is null or p <> event_type),
d as (select user_id, event_type, sum(epoch_us(nx) - epoch_us(ts))::bigint as micros from f where nx is not null group by all)"""


@query(f"with {_STAGES} select * from d")
def stage_durations(spark, d):
    return jobs.stage_durations(table(spark, d, "events"), "user_id", "event_type", "ts", ["ts", "event_id"])


@query(f"with {_STAGES} select *, micros::double / sum(micros) over (partition by user_id) as ratio from d where micros > 0")
def stage_ratios(spark, d):
    return jobs.ratios(stage_durations(spark, d), "user_id", "event_type", "micros")


@query("""with p as (select *, greatest(least(value, 100.0), 0.0) as v, greatest(least((12 - event_id % 13) * 100.0::double / 12, 100.0), 0.0) as z from events)
select user_id, event_id, max(greatest(v, z)) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as sub_percent from p""")
def progress_monotone(spark, d):
    e = table(spark, d, "events").withColumn("cur", F.col("event_id") % 13).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(12))
    return jobs.monotone(e, "user_id", "event_type", "value", ["ts", "event_id"], ("cur", "lo", "hi")).select("user_id", "event_id", "sub_percent")


_LINES = ("'0...10...' || k", "'Processing: ' || k || '.5 %'", "'100 - done.'", "'overview for zoom level ' || k", "'Zoom=' || k || ' no number'", "k || ' tiles written'", "'...' || k || '-' || k || '...20...'")
_LINE = "case event_id % 7 " + " ".join(f"when {n} then {x}" for n, x in enumerate(_LINES)) + " end"


@query(f"""with e as (select event_id, (json_extract_string(props, '$.k')::int % 150)::varchar as k from events), t as (select event_id, {_LINE} as t from e),
n as (select event_id, t, list_transform(regexp_extract_all(replace(t, '...', '......'), '(?:^|[.][.][.])([0-9]+)(?:[.][.][.]|$|[ ]|-)', 1), lambda x: x::double) as steps,
  list_transform(regexp_extract_all(t, '([0-9]+(?:[.][0-9]+)?) *%', 1), lambda x: x::double) as percents, regexp_extract(lower(t), '(?:zoom(?: +level)?|overview(?: +for)?(?: +zoom(?: +level)?)?)[ :=-]*([0-9]+)', 1) as z from t)
select event_id, least(100.0, case when regexp_matches(t, '100.*done') then 100.0 else list_max(list_concat([5.0::double], steps, percents)) end) as percent, nullif(z, '')::int as zoom from n""")
def progress_parse(spark, d):
    e = table(spark, d, "events").withColumn("k", (F.get_json_object("props", "$.k").cast("int") % 150).cast("string"))
    t = e.withColumn("t", F.expr(_LINE))
    return t.select("event_id", progress.parse_progress(F.col("t"), F.lit(5.0)).alias("percent"), progress.parse_zoom(F.col("t")).alias("zoom"))


@query("""with e as (select user_id, list({'s': epoch_us(ts)::double / 1000000 / 3600, 'p': least(100.0, greatest(0.0, value)), 'n': 0} order by ts, event_id) as l from events group by user_id)
select user_id, list_reduce(list_prepend({'s': -1e18::double, 'p': -1.0::double, 'n': 0}, l), lambda a, x: case when x.s - a.s < 30 and abs(x.p - a.p) < 20 then a else {'s': x.s, 'p': x.p, 'n': a.n + 1} end).n::bigint as emissions from e""")
def progress_throttle(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1_000_000 / 3600).withColumn("p", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value"))))
    return jobs.throttled(e, "user_id", "s", "p", ["ts", "event_id"], min_seconds=30, min_points=20)


@query("""with e as (select event_type, list(value order by ts, event_id) as l from events group by event_type)
select event_type, len(l) as n, round(list_reduce(list_prepend(0.5::double, l), lambda a, x: 0.75::double * a + 0.25::double * x), 6) as average, case when len(l) >= 3 then 'historical' else 'default' end as weight_source from e""")
def ema_calibration(spark, d):
    e = table(spark, d, "events")
    m = jobs.moving_average(e, "event_type", ["ts", "event_id"], "value", start=0.5).join(jobs.calibrated(e, "event_type"), "event_type")
    return m.select("event_type", "n", F.round("average", 6).alias("average"), "weight_source")


@query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by user_id")
def job_latest_state(spark, d):
    return jobs.latest(table(spark, d, "events"), "user_id", F.col("event_id"), ["event_type", "value", "event_id"])


_STATUS = ("completed", "failed", "running", "  TILING ", "strange", "")


@query(f"""with o as (select o_orderkey, o_orderdate as a, {_choice_sql(_STATUS, "o_orderkey")} as s, case when o_orderkey % 4 = 0 then o_orderdate + interval 5 minute end as c, case when o_orderkey % 3 <> 0 then o_orderdate + interval 90 second end as u, o_orderkey % 50 = 0 as bad from orders)
select o_orderkey, case when not bad then round(greatest(0, epoch_us(coalesce(c, case when s in ('completed', 'failed') then coalesce(u, a) else timestamp '2024-02-01 00:00:00' end)) - epoch_us(a)) / 1000000.0::double, 3) end as elapsed_seconds,
case when s is null or trim(s) = '' then 'queued' when lower(trim(s)) in ('queued', 'running', 'preprocessing', 'tiling', 'publishing', 'completed', 'failed') then lower(trim(s)) else 'running' end as status from o""")
def job_elapsed(spark, d):
    k, iso = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")).withColumn("s", _choice(_STATUS, "o_orderkey"))
    made = F.when(k % 50 == 0, F.lit("no date")).otherwise(iso("at"))
    done, upd = F.when(k % 4 == 0, iso(F.expr("at + interval 5 minutes"))), F.when(k % 3 != 0, iso(F.expr("at + interval 90 seconds")))
    return o.select("o_orderkey", progress.elapsed_seconds(made, done, F.col("s"), upd, F.lit(NOW)).alias("elapsed_seconds"), progress.normal_status(F.col("s")).alias("status"))


_STAGE = ("queued", "gdal_preprocess", "ctb_tile", "register_tileset", "failed", "odd")


@query(f"""with e as (select event_id, {_choice_sql(_STAGE, "event_id")} as s, (event_id % 121 - 10)::double as p from events), r as (select *, case s when 'gdal_preprocess' then 2 when 'ctb_tile' then 25 when 'register_tileset' then 95 else 0 end as a,
case s when 'queued' then 0 when 'gdal_preprocess' then 25 when 'ctb_tile' then 95 when 'register_tileset' then 99 else 100 end as b from e)
select event_id, round(a + (b - a) * least(100, greatest(0, p)) / 100.0::double, 2) as percent, least(round(a + (b - a) * least(100, greatest(0, p)) / 100.0::double, 2), case when s = 'failed' then 99.99::double else 100 end) as shown from r""")
def overall_progress(spark, d):
    e = table(spark, d, "events").select("event_id", F.coalesce(_choice(_STAGE, "event_id"), F.lit("none")).alias("s"), (F.col("event_id") % 121 - 10).cast("double").alias("p"))
    return e.select("event_id", progress.overall_percent(F.col("s"), F.col("p")).alias("percent"), progress.shown_percent(F.col("s"), F.col("p")).alias("shown"))


@query("""with e as (select event_id, case when event_id % 2 = 0 then 0.15::double else 0 end as f, case when event_id % 3 = 0 then 0.15::double else 0 end as o, (event_id % 130)::double as p from events)
select event_id, round(1 - f - o, 6) as reproject, f as fill, o as overview, round(least(100, 60 + p * (1 - f - o)), 6) as emitted from e""")
def step_progress(spark, d):
    k = F.col("event_id")
    w = progress.step_weights(k % 2 == 0, k % 3 == 0)
    e = table(spark, d, "events").select("event_id", w.alias("w"), (k % 130).cast("double").alias("p"))
    return e.select("event_id", F.round("w.reproject", 6).alias("reproject"), "w.fill", "w.overview", F.round(progress.step_percent(F.lit(60.0), F.col("p"), F.col("w.reproject")), 6).alias("emitted"))


_LOGS = ("ERROR: Unknown argument: --progress", "unknown argument: -progress", "Unknown option x for progress", "unknown option -x", "progress 5 %")


@query(f"""with e as (select event_id, {_choice_sql(_LOGS, "event_id")} as t, event_id % 9 + 1 as k from events)
select event_id, lower(t) like '%unknown argument: -progress%' or lower(t) like '%unknown argument: --progress%' or (lower(t) like '%unknown option%' and lower(t) like '%progress%') as unsupported, least(15000, 1000 * power(2, k - 1))::int as wait_millis from e""")
def tool_and_retry(spark, d):
    e = table(spark, d, "events").select("event_id", _choice(_LOGS, "event_id").alias("t"), (F.col("event_id") % 9 + 1).alias("k"))
    return e.select("event_id", progress.flag_unsupported(F.col("t")).alias("unsupported"), progress.retry_millis(F.col("k")).alias("wait_millis"))


@query("""with w as (select c_mktsegment, c_custkey, case when c_mktsegment = 'BUILDING' then 0 else c_custkey % 10 end::double as w from customer), t as (select *, sum(w) over (partition by c_mktsegment) as t from w)
select c_custkey, round(case when t > 0 then w / t else w end, 12) as weight from t""")
def normalised_weights(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0)).otherwise(F.col("c_custkey") % 10).cast("double").alias("weight"))
    return jobs.normalise(c, "c_mktsegment").select("c_custkey", F.round("weight", 12).alias("weight"))


# lineage


@query("""with c as (select c_custkey as k from customer)
select k::varchar as job_id, case when k % 3 = 0 then 'tiling' when k % 2 = 0 then 'failed' else 'completed' end as status, case when k % 3 = 0 then 'ctb_tile' when k % 2 = 0 then 'failed' else 'done' end as stage,
case when k % 3 = 0 or k % 2 = 0 then 0.0 else 100.0 end::double as percent, case when k % 3 = 0 then 'live' when k % 2 = 0 then 'disk full' else 'Completed' end as message, k % 3 <> 0 as from_disk,
case when k % 3 = 0 then 'l' when k % 2 = 0 then 'm' else 't' end as output_dir from c where k % 3 = 0 or k % 2 = 0 or k % 5 = 0""")
def job_detail_fallback(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("job_id"), F.lit("/w/x.tif").alias("input_path"), F.lit("m").alias("output_dir"), F.lit("2024-01-01").alias("at"), F.lit("{}").alias("request"))
    ends = c.where("k % 2 = 0").select("job_id", "at", F.lit("disk full").alias("error"), F.lit(None).cast("string").alias("terrain_url"), F.lit(None).cast("string").alias("tileset_name"))
    m = lineage.finished(lineage.created(c.where("k % 2 = 0")), ends)
    status = F.lit("tiling")
    live = lineage.job_from_manifest(lineage.created(c.where("k % 3 = 0"))).withColumn("status", status).withColumn("stage", progress.stage_of_status(status)).withColumn("output_dir", F.lit("l"))
    live = live.withColumn("progress", F.struct(F.lit(0.0).alias("percent"), F.lit("tiling").alias("phase"), F.lit("live").alias("message"))).drop("from_disk")
    found = lineage.resolve_jobs(c, live, m, c.where("k % 5 = 0").select("job_id", F.lit("t").alias("tiles_dir")))
    return found.select("job_id", "status", "stage", "progress.percent", "progress.message", "from_disk", "output_dir")


@query("""select event_id, user_id::varchar as job_id, event_type as status, 'k,note' as metadata_keys, json_extract_string(props, '$.k') as k, epoch_us(timestamp '2024-02-01 00:00:00') / 1000000.0::double - epoch_us(date_trunc('second', ts)) / 1000000.0::double as elapsed_seconds from events""")
def job_detail_residual(spark, d):
    e = table(spark, d, "events")
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.get_json_object("props", "$.k").alias("k"), F.lit("x").alias("note"), F.lit("{}").alias("request")))
    with_id = e.select("event_id", doc.alias("document"))
    fields = lineage.job_detail(with_id.withColumn("document", F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('",'), F.substring("document", 2, 1 << 30))), F.lit(NOW))
    m = F.col("metadata")
    return fields.select(m["event_id"].cast("long").alias("event_id"), "job_id", "status", F.array_join(F.array_sort(F.array_remove(F.map_keys(m), "event_id")), ",").alias("metadata_keys"), m["k"].alias("k"), "elapsed_seconds")


@query("""select o_orderkey, 'set-' || o_orderkey as tileset_name, c_name as file_name, '/w/' || c_name as input_path, 1 as schema_version from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0""")
def provenance_lineage(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("job_id"), F.concat(F.lit("set-"), "o_orderkey").alias("tileset_name"))
    # every other customer has no manifest: those tilesets have no known source
    m = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("job_id"), F.concat(F.lit("/w/"), "c_name").alias("input_path"), F.lit("o").alias("output_dir"), F.lit("t").alias("at"), F.lit(None).cast("string").alias("request"))
    return lineage.provenance(o, lineage.created(m)).select("o_orderkey", "tileset_name", F.col("source.file_name").alias("file_name"), F.col("source.input_path").alias("input_path"), "schema_version")


@query("""select user_id, arg_max(event_type, event_id) filter (event_id % 2 = 0) as status, (case when max(event_id) filter (event_id % 3 = 0) is not null then last(case when event_id % 6 = 0 then null else props end order by event_id) filter (event_id % 3 = 0) end) as error, max(event_id) as updated from events group by user_id""")
def manifest_merge(spark, d):
    k = F.col("event_id")
    sets = F.filter(F.array(F.when(k % 2 == 0, F.lit("status")), F.when(k % 3 == 0, F.lit("error"))), lambda x: x.isNotNull())
    e = table(spark, d, "events").select("user_id", k, F.col("event_type").alias("status"), F.when(k % 6 != 0, F.col("props")).alias("error"), sets.alias("sets"))
    return lineage.merge_changes(e, "user_id", "event_id", ["status", "error"])


@query("""with l as (select *, max(ts) over (partition by user_id) as l from events) select event_id, user_id from l where floor(epoch_us(timestamp '2024-02-06 02:00:00') / 1000000) - floor(epoch_us(l) / 1000000) <= 604800""")
def job_expiry(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return lineage.unexpired(e, "user_id", "ts", F.lit("2024-02-06 02:00:00").cast("timestamp")).select("event_id", "user_id")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'queued' when c_custkey % 2 = 0 then 'failed' else 'completed' end as status, case when c_custkey % 3 = 0 then 't0' else 't1' end as updated_at,
case when c_custkey % 3 <> 0 then 't1' end as completed_at, case when c_custkey % 3 <> 0 and c_custkey % 2 = 0 then 'broke' end as error, c_custkey % 6 in (1, 5) and c_custkey % 5 <> 0 as published,
case when c_custkey % 6 in (1, 5) and c_custkey % 5 <> 0 then 'set' || c_custkey end as tileset_name, c_name as file_name from customer""")
def manifest_endings(spark, d):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    c = table(spark, d, "customer").select("c_custkey", k.cast("string").alias("job_id"), F.concat(F.lit("/in/"), "c_name").alias("input_path"), F.lit("o").alias("output_dir"), F.lit("t0").alias("at"), none.alias("request"))
    ends = c.where("c_custkey % 3 <> 0").select("job_id", F.lit("t1").alias("at"), F.when(k % 2 == 0, F.lit("broke")).alias("error"), F.when(k % 5 != 0, F.lit("http://h")).alias("terrain_url"), F.concat(F.lit("set"), k).alias("tileset_name"))
    m = lineage.finished(lineage.created(c), ends)
    return m.select(F.col("job_id").cast("long").alias("c_custkey"), "status", "updated_at", "completed_at", "error", "publish.published", "publish.tileset_name", "source.file_name")


@query("""with j as (select o_orderkey, case o_orderkey % 5 when 0 then 'completed' when 1 then 'publishing' when 2 then 'failed' when 3 then 'running' else 'completed' end as status, case when o_orderkey % 7 <> 0 then 'd' end as output_dir from orders)
select * from j where status in ('completed', 'publishing') and output_dir is not null""")
def publishable_jobs(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "publishing", "failed", "running", "completed")]), (k % 5 + 1).cast("int"))
    return catalog.publishable(table(spark, d, "orders").select("o_orderkey", status.alias("status"), F.when(k % 7 != 0, F.lit("d")).alias("output_dir")))


@query("""select 'n' || c_custkey as name, case when c_custkey % 2 = 0 then 'cache' when c_custkey % 3 = 0 then 'sidecar' when c_custkey % 5 = 0 then 'layer' end as format, case when c_custkey % 2 = 0 or c_custkey % 3 = 0 or c_custkey % 5 = 0 then (c_custkey % 4)::int end as min_zoom from customer""")
def display_priority(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), "c_custkey").alias("name"))
    none = F.lit(None).cast("string")
    meta = lambda rows, what: rows.select("name", F.lit(what).alias("format"), none.alias("format_label"), none.alias("projection"), none.alias("crs"), (F.col("c_custkey") % 4).cast("int").alias("min_zoom"), F.lit(9).alias("max_zoom"))
    found = catalog.display_metadata(c.select("name"), meta(c.where("c_custkey % 2 = 0"), "cache"), meta(c.where("c_custkey % 3 = 0"), "sidecar"), meta(c.where("c_custkey % 5 = 0"), "layer"))
    return found.select("name", "format", "min_zoom")


# display


@query("""with s as (select l_orderkey * 7 + l_linenumber as id, (l_partkey * l_partkey * l_suppkey * 31 + l_linenumber) as b, l_extendedprice - 5000 as h, (l_partkey * 37) % 100000 as e from lineitem)
select id, case when b < 1024 then b || ' B' when b < 1048576 then format('{:.1f}', floor(b::double / 1024 * 10 + 0.5) / 10) || ' KB' when b < 1073741824 then format('{:.1f}', floor(b::double / 1048576 * 10 + 0.5) / 10) || ' MB' else format('{:.2f}', floor(b::double / 1073741824 * 100 + 0.5) / 100) || ' GB' end as size,
case when e >= 3600 then (e // 3600) || '小时' || (e % 3600 // 60) || '分' || (e % 60) || '秒' when e >= 60 then (e // 60) || '分' || (e % 60) || '秒' else e || '秒' end as elapsed,
case when e % 5 = 0 then '—' when e % 7 = 0 then (e % 20)::varchar else (e % 20) || '–' || (e % 20 + 2) end as zooms from s""")
def display_numbers(spark, d):
    b = F.col("l_partkey") * F.col("l_partkey") * F.col("l_suppkey") * 31 + F.col("l_linenumber")
    s = table(spark, d, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("id"), b.alias("b"), ((F.col("l_partkey") * 37) % 100000).alias("e"))
    least, most = F.when(F.col("e") % 5 != 0, F.col("e") % 20), F.when(F.col("e") % 7 == 0, F.col("e") % 20).otherwise(F.col("e") % 20 + 2)
    return s.select("id", display.show_size(F.col("b")).alias("size"), display.show_elapsed(F.col("e")).alias("elapsed"), display.show_zooms(least, most).alias("zooms"))


@query(f"""with {SOUNDINGS}, b as (select z, min(x) as sx, min(y) as sy, max(x) as ex, max(y) as ey from t group by z),
r as (select z, -180.0::double + sx * (360.0::double / (2 << z)) as w, -90.0::double + sy * (180.0::double / (1 << z)) as s, -180.0::double + (ex + 1) * (360.0::double / (2 << z)) as e, -90.0::double + (ey + 1) * (180.0::double / (1 << z)) as n from b),
m as (select z, greatest(abs(radians(e - w) * 6378137 * cos(radians((s + n) / 2))), abs(radians(n - s) * 6378137)) / (1 << (2 * z)) as span from r)
select z, round(span, 3) as span, round(least(120000, greatest(3000, span * 0.55)), 3) as height, least(50.0, greatest(1.0, (case when z % 3 <> 0 then z * z end)::double)) as exaggeration from m""".replace("least(50.0, greatest(1.0, (case when z % 3 <> 0 then z * z end)::double))", "least(50.0::double, greatest(1.0::double, coalesce((case when z % 3 <> 0 then z * z end)::double, 1)))"))
def view_of_tiles(spark, d):
    b = tile_rectangles(spark, d)
    m = b.select("z", (display.span_metres(F.col("west"), F.col("south"), F.col("east"), F.col("north")) / F.expr("shiftleft(1L, 2 * z)")).alias("m"))
    factor = F.when(F.col("z") % 3 != 0, (F.col("z") * F.col("z")).cast("double"))
    return m.select("z", F.round("m", 3).alias("span"), F.round(display.camera_height(F.col("m")), 3).alias("height"), display.exaggeration(factor).alias("exaggeration"))


@query(f"""with {GAPPY}, b as (select r, c, e, floor(e::double / 150) as b from gappy),
k as (select a.e, coalesce(x.b <> a.b, false) or coalesce(y.b <> a.b, false) as contour from b a left join b x on x.r = a.r and x.c = a.c + 1 left join b y on y.c = a.c and y.r = a.r + 1),
s as (select contour, greatest(0, least(255, floor((e + 500.0::double) * 256 / 3500)))::int as s from k where e is not null union all select contour, null from k where e is null)
select case when contour then '#ffffff' when s is not null then {_ramp_sql("ocean")} end as colour, count(*) as n from s group by 1""")
def shaded_cells(spark, d):
    low, high = display.checked_range(display.MIN_HEIGHT, display.MAX_HEIGHT)
    c = raster.contours(gappy(spark, d), 150)
    return c.select(display.shade(F.col("elev"), "ocean", low, high, F.col("contour")).alias("colour")).groupBy("colour").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select 'job' || (l_partkey % 3) || case l_suppkey % 4 when 0 then '/x/' when 1 then '/' else '/tiles/' end || (l_linenumber % 3) || '/' || (l_partkey % 5) || '/' || (l_suppkey % 7) || case l_quantity::int % 3 when 0 then '.terrain' when 1 then '.terrain.gz' else '.TERRAIN' end as path from lineitem)
select regexp_extract(path, '([0-9]+)/([0-9]+)/([0-9]+)[.]terrain$', 1)::int as z, regexp_extract(path, '([0-9]+)/([0-9]+)/([0-9]+)[.]terrain$', 2)::bigint as x, regexp_extract(path, '([0-9]+)/([0-9]+)/([0-9]+)[.]terrain$', 3)::bigint as y, count(*) as n from p where regexp_matches(path, '/[0-9]+/[0-9]+/[0-9]+[.]terrain$') group by all""")
def tile_paths(spark, d):
    k = lambda c, n: (F.col(c) % n).cast("string")
    folder = F.when(F.col("l_suppkey") % 4 == 0, F.lit("/x/")).when(F.col("l_suppkey") % 4 == 1, F.lit("/")).otherwise(F.lit("/tiles/"))
    kind = F.col("l_quantity").cast("int") % 3
    end = F.when(kind == 0, F.lit(".terrain")).when(kind == 1, F.lit(".terrain.gz")).otherwise(F.lit(".TERRAIN"))
    paths = table(spark, d, "lineitem").select(F.concat(F.lit("job"), k("l_partkey", 3), folder, k("l_linenumber", 3), F.lit("/"), k("l_partkey", 5), F.lit("/"), k("l_suppkey", 7), end).alias("path"))
    return tile_addresses(paths).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


_BLANKS = ("\t", " a\n", "b  c ", "", "\u00a0d\r")
_PATHS = "case c_custkey % 4 when 0 then 'D:' || chr(92) || 'foo' || chr(92) || 'bar' when 1 then 'C:' when 2 then '/data/x' else 'rel' || chr(92) || 'y' end"


@query(f"""with s as (select c_custkey, trim({_choice_sql(_BLANKS, "c_custkey")}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as t, replace({_PATHS}, chr(92), '/') as p from customer)
select c_custkey, nullif(t, '') as trimmed, case when p[2] = ':' then rtrim('//' || lower(p[1]) || '/' || ltrim(p[3:], '/'), '/') else p end as bound from s""")
def trimmed_and_bound(spark, d):
    k = F.col("c_custkey")
    path = F.element_at(F.array(*[F.lit(x) for x in ("D:\\foo\\bar", "C:", "/data/x", "rel\\y")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", labels.trim_to_null(_choice(_BLANKS, "c_custkey")).alias("trimmed"), labels.bind_source(path).alias("bound"))
