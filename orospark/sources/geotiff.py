"""Reader of single-band GeoTIFF and BigTIFF files, block by block: strips or tiles; plain, deflate or LZW; predictors 1, 2 and 3."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orospark.sources.files import listed, open_file

# Sizes and codes of the format's types, tags and keys as the public specifications name them.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_PLAIN, _LZW, _DEFLATE = 1, 5, (8, 32946)
_MODEL, _RASTER, _GEOGRAPHIC, _PROJECTED, _USER = 1024, 1025, 2048, 3072, 32767

Read = Callable[[int, int], bytes]


def _reader(data: bytes | Read) -> Read:
    return data if callable(data) else lambda at, n: data[at : at + n]


def tags(data: bytes | Read) -> dict[int, tuple]:
    """Values of the first directory's tags; text as one string. data is a file's bytes, or a function that reads n at a place."""
    read = _reader(data)
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    counter, entry, room = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    skip, wide = struct.calcsize(order + counter), struct.calcsize(order + entry)
    out: dict[int, tuple] = {0: (order,)}
    n_tags = struct.unpack(order + counter, read(at, skip))[0]
    directory = read(at + skip, n_tags * (wide + room))
    for k in range(n_tags):
        own = directory[k * (wide + room) : (k + 1) * (wide + room)]
        tag, kind, n = struct.unpack(order + entry, own[:wide])
        if kind not in _SIZES:
            continue
        size = n * _SIZES[kind]
        raw = own[wide : wide + size] if size <= room else read(struct.unpack(order + ("Q" if big else "I"), own[wide:])[0], size)
        out[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + f"{n}{_CODES[kind]}", raw) if kind in _CODES else (raw,)
    return out


def crs(t: dict[int, tuple]) -> str | None:
    """EPSG:4326 or EPSG:3857 as the geo keys name it, None without keys; any other system is refused."""
    keys = t.get(34735)
    if not keys:
        return None
    named = {keys[k]: keys[k + 3] for k in range(4, 4 + 4 * keys[3], 4) if keys[k + 1] == 0}
    model, code = named.get(_MODEL), None
    if model == 2:
        code = named.get(_GEOGRAPHIC, _USER)
    elif model == 1:
        code = named.get(_PROJECTED, _USER)
    if model == 2 and code in (4326, 4979):
        return "EPSG:4326"
    if model == 1 and code in (3857, 900913, 3785):
        return "EPSG:3857"
    raise ValueError(f"the file's reference system (model {model}, code {code}) isn't known: only EPSG:4326 and EPSG:3857 are")


@dataclass(frozen=True)
class Layout:
    """What it takes to decode a block."""

    dtype: str
    width: int
    height: int
    bands: int
    packing: int
    predictor: int
    block_width: int
    block_height: int
    tiled: bool
    nodata: float | None

    def spot(self, k: int) -> tuple[int, int]:
        """First row and column of block k."""
        across = -(-self.width // self.block_width)
        return k // across * self.block_height, k % across * self.block_width


def layout(t: dict[int, tuple]) -> tuple[Layout, tuple[int, ...], tuple[int, ...]]:
    """Layout, and offsets and sizes of the blocks."""
    width, height = t[256][0], t[257][0]
    bits, kind, packing, predictor = t.get(258, (1,))[0], t.get(339, (1,))[0], t.get(259, (1,))[0], t.get(317, (1,))[0]
    if packing not in (_PLAIN, _LZW, *_DEFLATE) or bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or t.get(284, (1,))[0] != 1:
        raise ValueError("only plain, deflated or LZW samples of whole bytes, interleaved, are read")
    if predictor not in (1, 2, 3) or (predictor == 3) > (kind == 3):
        raise ValueError("only predictors 1 to 3 are read, 3 for floats")
    tiled = 322 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
    nodata = t.get(42113, (None,))[0]
    nodata = float(nodata) if nodata not in (None, "") else None
    own = Layout(f"{t[0][0]}{'uif'[kind - 1]}{bits // 8}", width, height, t.get(277, (1,))[0], packing, predictor, bw, bh, tiled, nodata)
    return own, (t[324] if tiled else t[273]), (t[325] if tiled else t[279])


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, that widen one entry early."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, width, held, n, last = [], 9, 0, 0, b""
    for byte in data:
        held, n = held << 8 | byte, n + 8
        while n >= width:
            n -= width
            code, held = held >> n, held & ((1 << n) - 1)
            if code == 257:
                return b"".join(out)
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if last:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            else:
                entry = table[code]
            out.append(entry)
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return b"".join(out)


def unpack_block(raw: bytes, own: Layout, k: int) -> np.ndarray:
    """First band of block k, cut to the raster; a block without bytes is nodata (0 where there is none)."""
    r, c = own.spot(k)
    rows, cols = (own.block_height if own.tiled else min(own.block_height, own.height - r)), own.block_width
    dtype = np.dtype(own.dtype)
    shown = (slice(0, max(0, own.height - r)), slice(0, own.width - c))
    if not raw:
        return np.full((rows, cols), own.nodata or 0, dtype.newbyteorder("="))[shown]
    data = raw if own.packing == _PLAIN else unpack_lzw(raw) if own.packing == _LZW else zlib.decompress(raw)
    n, size = rows * cols * own.bands, dtype.itemsize
    if own.predictor == 3:  # bytes by significance, each the difference to the one a pixel before
        planes = np.frombuffer(data, np.uint8, n * size).reshape(rows, cols * size, own.bands)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, cols * own.bands)
        block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, own.bands)
    else:
        block = np.frombuffer(data, dtype, n).reshape(rows, cols, own.bands)
        if own.predictor == 2:
            whole = np.dtype(f"{own.dtype[0]}u{size}")
            block = np.cumsum(block.view(whole), axis=1, dtype=whole.newbyteorder("=")).view(dtype.newbyteorder("="))
    return block[:, :, 0][shown].astype(dtype.newbyteorder("="))


def decode(data: bytes | Read) -> tuple[np.ndarray, float | None]:
    """The first band and its nodata value, of a file that fits in memory."""
    read = _reader(data)
    own, offsets, counts = layout(tags(read))
    out = np.zeros((own.height, own.width), np.dtype(own.dtype).newbyteorder("="))
    for k, (a, n) in enumerate(zip(offsets, counts, strict=True)):
        block = unpack_block(read(a, n), own, k)
        r, c = own.spot(k)
        out[r : r + block.shape[0], c : c + block.shape[1]] = block
    return out, own.nodata


def place(data: bytes | Read) -> tuple[float, float, float, float, int, int]:
    """(west, north, width and height of a cell, rows, columns), in the units of the reference system; the whole world in
    degrees where no place is given. Where points are given instead of cells, the edges lie half a cell out."""
    t = tags(data)
    width, height = t[256][0], t[257][0]
    if 33550 not in t or 33922 not in t:
        return -180.0, 90.0, 360.0 / width, 180.0 / height, height, width
    (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
    keys = t.get(34735, ())
    half = 0.5 if any(keys[k] == _RASTER and keys[k + 3] == 2 for k in range(4, len(keys) - 3, 4)) else 0.0
    return x - (i + half) * sx, y + (j + half) * sy, sx, sy, height, width


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, west, north, dx, dy, rows, cols, crs) of the files that a path names, from their headers; crs is null without
    geo keys, another system than the two known ones is an error."""

    def run(batches):
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                with open_file(name) as read:
                    rows.append((*place(read), crs(tags(read))))
            columns = [pa.array([r[k] for r in rows], pa.float64() if k < 4 else pa.int64() if k < 6 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["raster_id", "west", "north", "dx", "dy", "rows", "cols", "crs"])

    return listed(spark, path).select("path").mapInArrow(run, "raster_id string, west double, north double, dx double, dy double, rows long, cols long, crs string")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, block, offset, size, layout): a row for each strip or tile of the files that a path names, from their headers."""

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with open_file(name) as read:
                    own, offsets, counts = layout(tags(read))
                text = json.dumps(own.__dict__)
                for k in range(0, len(offsets), 10_000):
                    a, n = offsets[k : k + 10_000], counts[k : k + 10_000]
                    columns = [pa.repeat(name, len(a)), pa.array(range(k, k + len(a)), pa.int64()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.repeat(text, len(a))]
                    yield pa.RecordBatch.from_arrays(columns, names=["raster_id", "block", "offset", "size", "layout"])

    return listed(spark, path).select("path").mapInArrow(run, "raster_id string, block long, offset long, size long, layout string")


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, row, col, elev) of the files that a path names, a double or null for nodata.

    Blocks are dealt out to all tasks, and each is read by its range and decoded by itself, so a file may be of any size."""
    blocks = read_blocks(spark, path)
    blocks = blocks.repartition(4 * spark.sparkContext.defaultParallelism, "raster_id", "block")

    def run(batches):
        for b in batches:
            names, numbers, offsets, sizes, texts = (c.to_pylist() for c in b.columns)
            for name, k, at, n, text in sorted(zip(names, numbers, offsets, sizes, texts, strict=True)):
                own = Layout(**json.loads(text))
                with open_file(name) as read:
                    part = unpack_block(read(at, n) if n else b"", own, k).astype(float)
                gone = np.isnan(part) | (part == own.nodata if own.nodata is not None else False)
                r, c = own.spot(k)
                rows, cols = np.indices(part.shape)
                yield pa.RecordBatch.from_arrays([pa.repeat(name, part.size), pa.array((rows + r).ravel(), pa.int64()), pa.array((cols + c).ravel(), pa.int64()), pa.array(part.ravel(), mask=gone.ravel())], names=["raster_id", "row", "col", "elev"])

    return blocks.mapInArrow(run, "raster_id string, row long, col long, elev double")
