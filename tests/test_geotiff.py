"""GeoTIFF: every codec, predictor and layout by exact round trips, codecs against known bytes."""

import itertools
import struct

import numpy as np
import pytest

from isohyet.sources import geotiff, rasters


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 40, b"\0" * 9000, np.random.default_rng(0).bytes(20_000), b"TOBEORNOTTOBEORTOBEORNOT" * 300])
def test_codecs(data):
    assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data
    assert geotiff.packbits_decode(geotiff.packbits_encode(data)) == data


def test_known_bytes():
    """The example of the TIFF specification for each codec."""
    assert geotiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert geotiff.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    for bad in (bytes([0x00, 0x80]), bytes([0x80, 0x7F, 0xFF])):
        with pytest.raises(ValueError):
            geotiff.lzw_decode(bad)


@pytest.mark.parametrize("compression,predictor,layout,planar", list(itertools.product(geotiff.COMPRESSIONS, (1, 2, 3), ({}, {"rows": 3}, {"tile": 16}), (False, True))))
def test_round_trip(compression, predictor, layout, planar):
    r = np.random.default_rng(1)
    lats, lons = np.linspace(50, 40, 21), np.linspace(10, 27, 35)
    for kind in ("f4",) if predictor == 3 else ("f4", "u1", "i2", "u4"):
        a = r.normal(size=(21, 35, 3)).astype("f4") if kind == "f4" else r.integers(0, 120, (21, 35, 3)).astype(kind)
        a[4:9] = a[4, 0]
        raw = geotiff.write_tiff(a, lats, lons, compression, predictor, planar=planar, **layout)
        for band in (1, 2, 3):
            got, info = geotiff.read_tiff(raw, band)
            assert got.dtype == np.dtype(kind) and np.array_equal(got, a[:, :, band - 1])
        assert info["pixel"] == pytest.approx((0.5, 0.5)) and info["origin"] == pytest.approx((9.75, 50.25))


def test_refusals():
    raw = geotiff.write_tiff(np.ones((2, 2)), np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    at = raw.index(struct.pack("<HHI", 259, 3, 1)) + 8
    with pytest.raises(ValueError, match="compression 7"):
        geotiff.read_tiff(raw[:at] + b"\x07" + raw[at + 1 :])
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.read_tiff(b"PNG" + raw)


def test_stack_of_codecs(spark, tmp_path):
    a = np.arange(40 * 50, dtype=np.float32).reshape(40, 50)
    a[3, 4] = np.nan
    for k, (c, layout) in enumerate(itertools.product(geotiff.COMPRESSIONS, ({"tile": 32}, {"rows": 7}))):
        (tmp_path / f"x_200101{k + 10}.tif").write_bytes(geotiff.write_tiff(a, np.linspace(60, 21, 40), np.arange(50.0), c, **layout))
    got = rasters.tiff_stack(spark, str(tmp_path)).groupBy("time").agg({"value": "sum", "y": "count", "lat": "max"}).collect()
    assert len(got) == 8 and all((r["sum(value)"], r["count(y)"], r["max(lat)"]) == (pytest.approx(np.nansum(a.astype(float))), 2000, 60.0) for r in got)
