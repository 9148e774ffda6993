import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from fernwerk.operators.spatial import Grid
from fernwerk.sources import geotiff as T

DATA = np.arange(35, dtype=float).reshape(5, 7) * 3 - 20


@pytest.fixture(autouse=True)
def source(spark):
    spark.dataSource.register(T.GeoTiffSource)


def load(spark, path, **options):
    rows = spark.read.format("geotiff").options(path=str(path), **options).load().collect()
    out = np.full((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1), np.inf)
    for r in rows:
        assert np.isinf(out[r["row"], r["col"]])
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


def tiff(path, blocks, tags, order="<"):
    """A file of blocks with the tags of its directory (number, field type, values); the offsets and sizes are added."""
    tiled = any(t == T.TILE_WIDTH for t, *_ in tags)
    at = np.cumsum([8, *map(len, blocks)]).tolist()
    tags = sorted([*tags, (T.TILE_OFFSETS if tiled else T.OFFSETS, 4, at[:-1]), (T.TILE_COUNTS if tiled else T.COUNTS, 4, [len(b) for b in blocks])])
    free, entries, more = at[-1] + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, v in tags:
        data = v if isinstance(v, bytes) else struct.pack(f"{order}{len(v)}{T.FIELDS[kind]}", *v)
        n = len(v)
        if len(data) > 4:
            data, more = struct.pack(f"{order}I", free + len(more)), more + data
        entries += struct.pack(f"{order}HHI", tag, kind, n) + data.ljust(4, b"\0")
    path.write_bytes({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, at[-1]) + b"".join(blocks) + struct.pack(f"{order}H", len(tags)) + entries + b"\0" * 4 + more)


def common(bits, kind, packing=1, predictor=1, samples=1):
    return [(T.WIDTH, 3, (7,)), (T.HEIGHT, 3, (5,)), (T.BITS, 3, (bits,) * samples), (T.PACKING, 3, (packing,)), (T.SAMPLES, 3, (samples,)), (T.SAMPLE_FORMAT, 3, (kind,) * samples), (T.PREDICTOR, 3, (predictor,))]


def test_what_is_written_is_read(spark, tmp_path):
    grid = Grid(450_000.0, 5_440_000.0, 30.0, 6, 7)
    cells = [(r, c, float(DATA[r, c])) for r in range(5) for c in range(7) if r != 2]
    cells[0] = (0, 0, None)
    path = tmp_path / "a.tif"
    T.write_geotiff(spark.createDataFrame(cells, "row int, col int, z double"), "z", grid, 32611, f"file://{path}")
    want = np.vstack([DATA, np.full((1, 7), np.nan)])
    want[0, 0], want[2] = np.nan, np.nan
    np.testing.assert_array_equal(load(spark, path), want)
    r = T.raster(str(path))
    assert (r.rows, r.cols, r.epsg, r.place) == (6, 7, 32611, (450_000.0, 5_440_000.0, 30.0, 30.0)) and np.isnan(r.nodata)


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_with_differences_and_no_data(spark, tmp_path, order):
    v = DATA.astype("i2")
    step = np.diff(v, axis=1, prepend=np.int16(0)).astype(f"{order}i2")
    tiff(tmp_path / "a.tif", [zlib.compress(step[i : i + 2].tobytes()) for i in (0, 2, 4)], [*common(16, 2, 8, 2), (T.STRIP_ROWS, 3, (2,)), (T.NODATA, 2, b"-14\0")], order)
    np.testing.assert_array_equal(load(spark, tmp_path / "a.tif"), np.where(DATA == -14, np.nan, DATA))


def test_tiles_of_floats_in_planes_of_bytes(spark, tmp_path):
    wide = np.zeros((16, 16), ">f4")
    wide[:5, :7] = DATA
    planes = wide.view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
    block = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    tiff(tmp_path / "a.tif", [zlib.compress(block.tobytes())], [*common(32, 3, 8, 3), (T.TILE_WIDTH, 3, (16,)), (T.TILE_HEIGHT, 3, (16,))])
    np.testing.assert_array_equal(load(spark, tmp_path / "a.tif"), DATA)


def test_bands_by_pixel(spark, tmp_path):
    both = np.stack([DATA + 20, DATA + 30], axis=2).astype("u1")
    tiff(tmp_path / "a.tif", [both.tobytes()], common(8, 1, samples=2))
    np.testing.assert_array_equal(load(spark, tmp_path / "a.tif", band="2"), DATA + 30)
    with pytest.raises(PySparkException, match="no band 3"):
        load(spark, tmp_path / "a.tif", band="3")


def test_what_is_not_read(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no picture")
    with pytest.raises(T.GeoTiffError):
        T.raster(str(tmp_path / "a.tif"))
