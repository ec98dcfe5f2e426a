"""Elevation rasters as data sources: SRTM tiles ("hgt") and plain GeoTIFF files ("geotiff") read as cell tables in bands of rows.

Files are reached through the file system that their path names, so inputs may lie in any store; a partition reads its rows
only, and its strips by their own offsets.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import contourflow
import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(contourflow)

CELLS = "terrain_id string, node long, i int, j int, z double, valid boolean"
VOID = -32768
# Samples a side of the two tile formats and their arc seconds.
TILES = {1201: 3.0, 3601: 1.0}
BAND_CELLS = 4_000_000


class RasterError(ValueError):
    """A file that is not what the reader takes; the message names the reason."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def tile_corner(name: str) -> tuple[int, int]:
    """South-west corner (latitude, longitude) of a tile by its name, such as N45E024."""
    m = re.fullmatch(r"([NS])(\d{2})([EW])(\d{3})", name.upper())
    if not m:
        raise RasterError(f"{name} is not the name of a tile")
    return int(m[2]) * (1 if m[1] == "N" else -1), int(m[4]) * (1 if m[3] == "E" else -1)


def tile_samples(size: int) -> int:
    for n in TILES:
        if size == 2 * n * n:
            return n
    raise RasterError(f"{size} bytes is no tile of {' or '.join(map(str, TILES))} samples a side")


def file_sha256(path: str) -> str:
    where, own = _open(path)
    mark = hashlib.sha256()
    with where.open_input_stream(own, compression=None) as f:
        while data := f.read(1 << 20):
            mark.update(data)
    return mark.hexdigest()


@dataclass
class Header:
    """What of a GeoTIFF the reader needs. transform: easting and northing of the first pixel's corner, pixel width and height."""

    n_rows: int
    n_cols: int
    dtype: str
    rows_per_strip: int
    offsets: tuple[int, ...]
    nodata: float | None
    transform: tuple[float, float, float, float] | None
    epsg: int | None


# TIFF field types (struct code, bytes) and the tags that are read.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, LENGTH, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, TILE_WIDTH, FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 284, 322, 339, 33550, 33922, 34735, 42113
PROJECTED_CRS, GEOGRAPHIC_CRS = 3072, 2048


def read_header(path: str) -> Header:
    """Parse and refuse: only classic, striped, uncompressed, one-band files with unpadded strips are taken."""
    where, own = _open(path)
    with where.open_input_file(own) as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or len(start) < 8:
            raise RasterError("not a TIFF file")
        magic, at = struct.unpack(order + "HI", start[2:])
        if magic == 43:
            raise RasterError("BigTIFF is not read")
        if magic != 42:
            raise RasterError(f"not a TIFF file: magic {magic}")
        f.seek(at)
        (n,) = struct.unpack(order + "H", f.read(2))
        entries = [struct.unpack(order + "HHI4s", f.read(12)) for _ in range(n)]
        tags = {}
        for tag, kind, count, raw in entries:
            if kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            if size * count > 4:
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size * count)
            tags[tag] = raw[:count] if code == "s" else struct.unpack(f"{order}{count}{code}", raw[: size * count])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if TILE_WIDTH in tags:
        raise RasterError("tiled files are not read")
    if one(COMPRESSION, 1) != 1:
        raise RasterError(f"compression {one(COMPRESSION, 1)} is not read")
    if one(SAMPLES, 1) != 1:
        raise RasterError(f"{one(SAMPLES, 1)} samples a pixel are not read")
    if one(PLANAR, 1) != 1:
        raise RasterError("planar files are not read")
    rows, cols = one(LENGTH, 0), one(WIDTH, 0)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    dtype = f"{order}{kind}{one(BITS, 1) // 8}"
    if dtype[1:] not in ("u2", "u4", "i2", "i4", "f4", "f8"):
        raise RasterError(f"samples of {one(BITS, 1)} bits in format {one(FORMAT, 1)} are not read")
    per = min(one(ROWS_PER_STRIP, rows), rows)
    offsets, counts = tags.get(OFFSETS, ()), tags.get(COUNTS, ())
    if len(offsets) != -(-rows // per):
        raise RasterError(f"{len(offsets)} strips do not hold {rows} rows by {per}")
    width = cols * np.dtype(dtype).itemsize
    for k, size in enumerate(counts):
        if size != min(per, rows - k * per) * width:
            raise RasterError(f"strip {k} is padded or short: {size} bytes")
    nodata = float(tags[NODATA].split(b"\0")[0]) if NODATA in tags else None
    transform, scale, tie = None, tags.get(SCALE), tags.get(TIEPOINT)
    if scale and tie:
        if abs(scale[0] - scale[1]) > 1e-9 * abs(scale[0]):
            raise RasterError("pixels are not square")
        transform = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1])
    keys = tags.get(GEO_KEYS, ())
    crs = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return Header(rows, cols, dtype, per, tuple(offsets), nodata, transform, crs.get(PROJECTED_CRS, crs.get(GEOGRAPHIC_CRS)))


def read_rows(path: str, head: Header, row0: int, n_rows: int, col0: int, n_cols: int, step: int = 1) -> np.ndarray:
    """Rows row0, row0 + step, ... of a rectangle, voids as NaN; nodata is compared in the file's own type."""
    if min(row0, col0) < 0 or row0 + n_rows > head.n_rows or col0 + n_cols > head.n_cols:
        raise RasterError("the window leaves the raster")
    kind, out = np.dtype(head.dtype), []
    where, own = _open(path)
    with where.open_input_file(own) as f:
        for row in range(row0, row0 + n_rows, step):
            strip, within = divmod(row, head.rows_per_strip)
            f.seek(head.offsets[strip] + (within * head.n_cols + col0) * kind.itemsize)
            out.append(np.frombuffer(f.read(n_cols * kind.itemsize), dtype=kind)[::step])
    raw = np.stack(out)
    z = raw.astype(np.float64)
    if head.nodata is not None:
        z[raw == np.array(head.nodata).astype(kind)] = np.nan
    return z


def _batch(terrain: str, z: np.ndarray, row0: int, n_cols: int) -> pa.RecordBatch:
    i, j = np.meshgrid(np.arange(row0, row0 + len(z)), np.arange(z.shape[1]), indexing="ij")
    flat, valid = z.ravel(), np.isfinite(z).ravel()
    columns = [pa.array([terrain] * len(flat)), pa.array((i * n_cols + j).ravel(), pa.int64()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(flat, mask=~valid), pa.array(valid)]
    return pa.RecordBatch.from_arrays(columns, names=["terrain_id", "node", "i", "j", "z", "valid"])


class _Band(InputPartition):
    def __init__(self, row0: int, n_rows: int) -> None:
        self.row0, self.n_rows = row0, n_rows


class _Reader(DataSourceReader):
    """Bands of rows of a window (row0, col0, nRows, nCols, stride), cells numbered within it."""

    def __init__(self, options: dict[str, str], head: Header) -> None:
        self.path, self.head = options["path"], head
        number = lambda k, d: int(options.get(k, options.get(k.lower(), d)))
        self.row0, self.col0, self.step = number("row0", 0), number("col0", 0), number("stride", 1)
        self.rows, self.cols = number("nRows", head.n_rows - self.row0), number("nCols", head.n_cols - self.col0)
        self.terrain = options.get("terrain_id", re.sub(r"\.\w+$", "", self.path.rsplit("/", 1)[-1]))

    def partitions(self) -> list[_Band]:
        per = max(1, BAND_CELLS // max(1, self.cols)) // self.step * self.step or self.step
        return [_Band(r, min(per, self.rows - r)) for r in range(0, self.rows, per)]

    def read(self, band: _Band) -> Iterator[pa.RecordBatch]:
        per = max(self.step, 65_536 // max(1, self.cols) // self.step * self.step)
        for r in range(band.row0, band.row0 + band.n_rows, per):
            z = read_rows(self.path, self.head, self.row0 + r, min(per, band.row0 + band.n_rows - r), self.col0, self.cols, self.step)
            yield _batch(self.terrain, z, r // self.step, -(-self.cols // self.step))


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options, read_header(self.options["path"]))


class HgtSource(DataSource):
    """A tile is one strip of big-endian 16-bit samples, north first."""

    @classmethod
    def name(cls) -> str:
        return "hgt"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: object) -> _Reader:
        where, own = _open(self.options["path"])
        n = tile_samples(where.get_file_info(own).size)
        return _Reader(self.options, Header(n, n, ">i2", n, (0,), VOID, None, 4326))


def register(spark: SparkSession) -> None:
    for source in (GeoTiffSource, HgtSource):
        spark.dataSource.register(source)
