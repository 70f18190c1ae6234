"""Column functions over layer descriptors, names, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tile formats, projections and their display labels.
FORMATS = {"Terrain": "heightmap-1.0", "Mesh": "quantized-mesh-1.0"}
PROJECTIONS = {"geodetic": "EPSG:4326", "mercator": "EPSG:3857"}
GEODETIC_CODES = ("EPSG:4326", "WGS84")
MERCATOR_CODES = ("EPSG:3857", "EPSG:900913")
MESH_LABEL = "量化网格 (Mesh)"
HEIGHTMAP_LABEL = "高度图 (Terrain)"
GEODETIC_LABEL = "EPSG:4326 (WGS84 / 地理)"
MERCATOR_LABEL = "EPSG:3857 (Web 墨卡托)"
PLACEHOLDER_NAMES = ("string", "example", "uuid", "name")
DEM_SUFFIXES = (".tif", ".tiff", ".dem", ".img")
RESERVED_FOLDERS = ("jobs", "uploads", "tilesets")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def trim_to_null(c: Column) -> Column:
    """Blank is null."""
    return F.nullif(strip(c), F.lit(""))


def format_label(fmt: Column) -> Column:
    low = F.lower(strip(fmt))
    return F.when(low.startswith("quantized-mesh"), F.lit(MESH_LABEL)).when(low.startswith("heightmap"), F.lit(HEIGHTMAP_LABEL)).otherwise(F.nullif(fmt, F.lit("")))


def crs_label(projection: Column) -> Column:
    code = F.upper(strip(projection))
    return F.when(code.isin(*GEODETIC_CODES), F.lit(GEODETIC_LABEL)).when(code.isin(*MERCATOR_CODES), F.lit(MERCATOR_LABEL)).otherwise(F.nullif(projection, F.lit("")))


def format_hint(fmt: Column) -> Column:
    """Output format that a descriptor's exact format names, else null."""
    low = F.lower(strip(fmt))
    out = F.lit(None).cast("string")
    for name, code in FORMATS.items():
        out = F.when(low == code, F.lit(name)).otherwise(out)
    return out


def profile_hint(projection: Column) -> Column:
    code = F.upper(strip(projection))
    return F.when(code.isin(*GEODETIC_CODES), F.lit("geodetic")).when(code.isin(*MERCATOR_CODES), F.lit("mercator"))


def publish_choice(request: Column, hint: Column, default: str) -> Column:
    """What the request says, else the descriptor, else the default."""
    return F.coalesce(request, hint, F.lit(default))


def tileset_name(job_id: Column, name: Column) -> Column:
    """The name to publish under; null where it isn't allowed.

    A blank or placeholder name falls back to the job's id. Besides separators and "..", names that start with a
    dot are turned down: they would never be listed, and "." would be the catalogue itself."""
    trimmed = strip(name)
    chosen = F.when(trimmed.isNull() | (trimmed == "") | F.lower(trimmed).isin(*PLACEHOLDER_NAMES), job_id).otherwise(trimmed)
    bad = (chosen == "") | chosen.contains("/") | chosen.contains("\\") | chosen.contains("..") | chosen.startswith(".")
    return F.when(~bad, chosen)


def terrain_url(base: Column, path: Column, name: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.rtrim(path, F.lit("/")), F.lit("/"), name)


def job_of_tiles(path: Column) -> Column:
    """The id in .../jobs/{id}/tiles, else null."""
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)jobs/([^/]+)/tiles/?$", 1), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """From the last dot, in lower case; none for names whose only dot leads."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def is_dem(name: Column) -> Column:
    return suffix(name).isin(*DEM_SUFFIXES)


def in_reserved_folder(relative: Column) -> Column:
    return F.element_at(F.split(relative, "/"), 1).isin(*RESERVED_FOLDERS)


def child_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def parent_path(relative: Column) -> Column:
    """Null for the root itself."""
    return F.when(relative != "", F.regexp_replace(relative, r"/?[^/]*$", ""))


def bind_source(path: Column) -> Column:
    """Left side of a container bind: C:\\a becomes //c/a, so its colon isn't taken for the separator."""
    text = F.translate(path, "\\", "/")
    rest = F.ltrim(F.substring(text, 3, 1 << 30), F.lit("/"))
    drive = F.concat(F.lit("//"), F.lower(F.substring(text, 1, 1)))
    return F.when(F.substring(text, 2, 1) == ":", F.when(rest == "", drive).otherwise(F.concat_ws("/", drive, rest))).otherwise(text)
