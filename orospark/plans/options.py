"""Options of preprocessing, tiling and publishing, checked as they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from orospark.functions.labels import FORMATS, PROJECTIONS
from orospark.operators.raster import METHODS


@dataclass(frozen=True)
class PreprocessOptions:
    target_crs: str = "EPSG:4326"
    fill_nodata: bool = True
    build_overviews: bool = True
    block_size: int = 256
    nodata_value: float | None = None

    def __post_init__(self):
        if self.block_size < 16 or self.block_size % 16:
            raise ValueError("block_size has to be a multiple of 16")
        if self.target_crs not in PROJECTIONS.values():
            raise ValueError(f"only {' and '.join(PROJECTIONS.values())} are known")


@dataclass(frozen=True)
class TileOptions:
    output_format: str = "Mesh"
    profile: str = "geodetic"
    thread_count: int | None = None
    tile_size: int | None = None
    start_zoom: int | None = None
    end_zoom: int | None = 0
    resampling_method: str = "average"
    error_threshold: float = 0.125
    warp_memory: int | None = None
    resume: bool = False
    mesh_qfactor: float = 1.0
    layer_only: bool = False
    cesium_friendly: bool = True
    vertex_normals: bool = True
    quiet: bool = False
    verbose: bool = False
    creation_options: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        for name, allowed in (("output_format", FORMATS), ("profile", PROJECTIONS), ("resampling_method", METHODS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        for name, least in (("thread_count", 1), ("tile_size", 1), ("start_zoom", 0), ("end_zoom", 0), ("warp_memory", 0)):
            v = getattr(self, name)
            if v is not None and v < least:
                raise ValueError(f"{name} is at least {least}")
        if self.error_threshold <= 0 or self.mesh_qfactor <= 0:
            raise ValueError("error_threshold and mesh_qfactor are over 0")

    @property
    def normals(self) -> bool:
        """Only meshes have normals."""
        return self.vertex_normals and self.output_format == "Mesh"

    def flags(self) -> list[str]:
        """The options in the command-line form of the usual tiling tool."""
        out = ["-f", self.output_format, "-p", self.profile, "-r", self.resampling_method, "-z", str(self.error_threshold)]
        for flag, v in (("-c", self.thread_count), ("-t", self.tile_size), ("-s", self.start_zoom), ("-e", self.end_zoom), ("-m", self.warp_memory)):
            out += [] if v is None else [flag, str(v)]
        quality = ["-g", str(self.mesh_qfactor)] if self.mesh_qfactor != 1.0 else []
        out += ["-R"] * self.resume + quality + ["-l"] * self.layer_only + ["-C"] * self.cesium_friendly
        out += ["-N"] * self.normals + ["-q"] * self.quiet + ["-v"] * self.verbose
        return out + [x for o in self.creation_options for x in ("-n", o)]


@dataclass(frozen=True)
class PublishOptions:
    auto_publish: bool | None = None
    tileset_name: str | None = None

    def publishes(self, default: bool = False) -> bool:
        return default if self.auto_publish is None else self.auto_publish
