"""GeoTIFF in and out: a Spark data source that reads blocks as partitions, and a sink that writes line by line.

``spark.dataSource.register(GeoTiffSource); spark.read.format("geotiff").option("path", ...).load()`` gives row, col and value; cells
without data are NULL. The file lies where every executor can open it as a file. Read are strips and tiles, integers and floats, classic
and big files, uncompressed or deflated, with any predictor; other compressions are an error.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fernwerk.operators.spatial import Grid
from fernwerk.sources.files import save

# Fixed values of the format: field types, tags and geo keys.
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, PACKING, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, SCALE, TIE, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
CELLS_A_PARTITION = 4_000_000


class GeoTiffError(ValueError):
    """A file that is no GeoTIFF, or one of a kind that is not read."""


@dataclass
class Raster:
    """What a file's head says."""

    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default: float | None = None) -> int:
        return self.tags.get(tag, (default,))[0]

    @property
    def rows(self) -> int:
        return self.one(HEIGHT)

    @property
    def cols(self) -> int:
        return self.one(WIDTH)

    @property
    def tiled(self) -> bool:
        return TILE_WIDTH in self.tags

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a block; the last strip may have fewer rows."""
        return (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if self.tiled else (min(self.one(STRIP_ROWS, self.rows), self.rows), self.cols)

    @property
    def across(self) -> int:
        return math.ceil(self.cols / self.block[1])

    @property
    def blocks(self) -> int:
        """Blocks of one band."""
        return self.across * math.ceil(self.rows / self.block[0])

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}.get(self.one(SAMPLE_FORMAT, 1))
        if kind is None or self.one(BITS, 1) not in (8, 16, 32, 64):
            raise GeoTiffError("this kind of number is not read")
        return np.dtype(f"{self.order}{kind}{self.one(BITS) // 8}")

    @property
    def nodata(self) -> float | None:
        text = b"".join(self.tags.get(NODATA, ())).rstrip(b"\0 ").decode("ascii", "replace")
        return float(text) if text else None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(PROJECTED) or found.get(GEOGRAPHIC)

    @property
    def place(self) -> tuple[float, float, float, float]:
        """Left and top edge, width and height of a cell; without a place in the world those of a grid of units from 0, 0."""
        if SCALE not in self.tags or TIE not in self.tags:
            return 0.0, 0.0, 1.0, 1.0
        dx, dy = self.tags[SCALE][:2]
        i, j, _, x, y = self.tags[TIE][:5]
        return x - i * dx, y + j * dy, dx, dy


def head(f: BinaryIO) -> Raster:
    """Reads the head and the first directory."""
    mark = f.read(4)
    order = {b"II": "<", b"MM": ">"}.get(mark[:2])
    version = struct.unpack(f"{order}H", mark[2:])[0] if order and len(mark) == 4 else 0
    if version not in (42, 43):
        raise GeoTiffError("not a TIFF file")
    big = version == 43
    if big:
        f.read(4)
    count, place, size = ("Q", "Q", 20) if big else ("H", "I", 12)
    get = lambda form: struct.unpack(order + form, f.read(struct.calcsize(order + form)))
    f.seek(get(place)[0])
    entries = [f.read(size) for _ in range(get(count)[0])]
    tags: dict[int, tuple] = {}
    for e in entries:
        tag, kind, n = struct.unpack(order + "HH" + place, e[: size - struct.calcsize(place)])
        if kind not in FIELDS:
            continue
        form, data = f"{order}{n}{FIELDS[kind]}", e[-struct.calcsize(place) :]
        if struct.calcsize(form) > len(data):
            f.seek(struct.unpack(order + place, data)[0])
            data = f.read(struct.calcsize(form))
        tags[tag] = struct.unpack(form, data[: struct.calcsize(form)])
    return Raster(order, tags)


def read_block(f: BinaryIO, r: Raster, i: int, band: int) -> tuple[int, int, np.ndarray]:
    """First row, first column and the values of one band of a block, cut to the raster."""
    split = r.one(PLANAR, 1) == 2
    at = i + band * r.blocks if split else i
    h, w = r.block
    row, col = i // r.across * h, i % r.across * w
    if not r.tiled:
        h = min(h, r.rows - row)
    bands = 1 if split else r.one(SAMPLES, 1)
    start, size = r.tags[TILE_OFFSETS if r.tiled else OFFSETS][at], r.tags[TILE_COUNTS if r.tiled else COUNTS][at]
    if not size:  # a block that was never written
        return row, col, np.full((min(h, r.rows - row), min(w, r.cols - col)), np.nan if r.nodata is None else r.nodata)
    f.seek(start)
    data = f.read(size)
    if r.one(PACKING, 1) in (8, 32946):
        data = zlib.decompress(data)
    elif r.one(PACKING, 1) != 1:
        raise GeoTiffError(f"compression {r.one(PACKING)} is not read")
    predictor, n = r.one(PREDICTOR, 1), h * w * bands
    if predictor == 3:
        k = r.dtype.itemsize
        raw = np.cumsum(np.frombuffer(data, np.uint8, n * k).reshape(h, -1, bands), axis=1, dtype=np.uint8)
        v = np.ascontiguousarray(raw.reshape(h, k, w * bands).transpose(0, 2, 1)).view(r.dtype.newbyteorder(">")).reshape(h, w, bands)
    else:
        v = np.frombuffer(data, r.dtype, n).reshape(h, w, bands)
        if predictor == 2:
            v = np.cumsum(v, axis=1, dtype=r.dtype.newbyteorder("="))
    return row, col, v[: r.rows - row, : r.cols - col, 0 if split else band]


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def raster(path: str) -> Raster:
    with open(local(path), "rb") as f:
        return head(f)


@dataclass
class Blocks(InputPartition):
    first: int
    last: int


class GeoTiffSource(DataSource):
    """Options: path, band (from 1)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema: object) -> DataSourceReader:
        return GeoTiffReader(dict(self.options))


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.band = local(options["path"]), int(options.get("band", 1)) - 1

    def partitions(self) -> list[Blocks]:
        r = raster(self.path)
        if not 0 <= self.band < r.one(SAMPLES, 1):
            raise GeoTiffError(f"there is no band {self.band + 1}")
        step = max(CELLS_A_PARTITION // (r.block[0] * r.block[1]), 1)
        return [Blocks(i, min(i + step, r.blocks)) for i in range(0, r.blocks, step)]

    def read(self, partition: Blocks) -> Iterator:
        import pyarrow as pa

        with open(self.path, "rb") as f:
            r = head(f)
            for i in range(partition.first, partition.last):
                row, col, v = read_block(f, r, i, self.band)
                value = v.astype(float).ravel()
                gone = np.isnan(value) | (False if r.nodata is None else value == r.nodata)
                at = np.indices(v.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel() + np.int32(row)), pa.array(at[1].ravel() + np.int32(col)), pa.array(value, mask=gone)], ["row", "col", "value"])


def write_geotiff(cells: DataFrame, value: str, grid: Grid, epsg: int, path: str) -> None:
    """One band of 32-bit floats, a strip a row, uncompressed, so that all places are known before the first line; NULL and absent cells
    are NaN. The driver holds one partition of lines at most. Over 4 GB the file is a big one."""

    def pieces() -> Iterator[bytes]:
        n, size = grid.rows, grid.cols * 4
        big = n * (size + 16) + 4096 >= 2**32
        place, wide = ("Q", 16) if big else ("I", 4)
        keys = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, GEOGRAPHIC if epsg == 4326 else PROJECTED, 0, 1, epsg)
        tags = [
            (WIDTH, 4, (grid.cols,)), (HEIGHT, 4, (n,)), (BITS, 3, (32,)), (PACKING, 3, (1,)), (262, 3, (1,)), (OFFSETS, wide, [0] * n), (SAMPLES, 3, (1,)), (STRIP_ROWS, 4, (1,)), (COUNTS, 4, [size] * n),
            (PLANAR, 3, (1,)), (SAMPLE_FORMAT, 3, (3,)), (SCALE, 12, (grid.resolution, grid.resolution, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, grid.left, grid.top, 0.0)), (KEYS, 3, keys), (NODATA, 2, [b"n", b"a", b"n", b"\0"]),
        ]
        slot, start = struct.calcsize(place), 16 if big else 8
        free = start + (8 if big else 2) + len(tags) * (4 + 2 * slot) + slot
        length = lambda kind, v: struct.calcsize(f"<{len(v)}{FIELDS[kind]}")
        first = free + sum(m for _, kind, v in tags if (m := length(kind, v)) > slot)
        entries, more = b"", b""
        for tag, kind, v in tags:
            if tag == OFFSETS:
                v = range(first, first + n * size, size)
            data = struct.pack(f"<{len(v)}{FIELDS[kind]}", *v)
            if len(data) > slot:
                data, more = struct.pack(f"<{place}", free + len(more)), more + data
            entries += struct.pack(f"<HH{place}", tag, kind, len(v)) + data.ljust(slot, b"\0")
        yield (struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)) + struct.pack("<Q" if big else "<H", len(tags)) + entries + b"\0" * slot + more
        seen = 0
        empty = np.full(grid.cols, np.nan, "<f4")
        lines = cells.where(F.col(value).isNotNull()).groupBy("row").agg(F.collect_list("col").alias("c"), F.collect_list(F.col(value).cast("float")).alias("v")).orderBy("row")
        for x in lines.toLocalIterator():
            line = empty.copy()
            line[x["c"]] = x["v"]
            for _ in range(seen, x["row"]):
                yield empty.tobytes()
            yield line.tobytes()
            seen = x["row"] + 1
        for _ in range(seen, n):
            yield empty.tobytes()

    save(cells.sparkSession, path, pieces())
