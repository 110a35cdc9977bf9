"""NetCDF cubes as a Spark data source: `spark.read.format("netcdf")` after `register(spark)`.

Classic files (CDF-1, CDF-2, CDF-5; fixed and record variables) are read by ranges, without any library. A partition is a
file, a variable and a slab of time steps. Filters on date, level and variable are pushed down: slabs outside the dates are
no partitions, and of the rest only the steps and levels that are wanted are read. A schema with fewer columns yields only
these. NetCDF-4 files are HDF5 and refused by name.

Columns: path, variable, y, x, lat, lon, level (Pa, null without a level axis), date, value. Dates follow the file's
calendar: no-leap years have no 29 February. Values are unpacked (scale_factor, add_offset); fill values and NaN are null.

Options: path (a folder, searched below, or a file), variable (names, by commas; all by default), levels (Pa, by commas:
of each the nearest in the file, under its own name; all by default), steps (time steps of a slab).
"""

from __future__ import annotations

import math
import operator
import re
import struct
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Element types of classic NetCDF.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Names of axes and what a unit of level is in Pa.
_LAT, _LON, _TIME, _LEVEL_UNITS = ("lat", "latitude"), ("lon", "longitude"), ("time",), {"hPa": 100.0, "millibars": 100.0, "millibar": 100.0, "mbar": 100.0}
#: Values of a slab by default, bytes of a header read at first, rows of a batch.
SLAB, _HEAD, _ROWS = 1 << 20, 1 << 16, 1 << 16
_MONTHS = np.cumsum([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    attrs: dict
    type: np.dtype
    begin: int
    stride: int  # bytes from a record to the next one; 0 for fixed variables

    def ranges(self, first: int, count: int) -> Iterator[tuple[int, int]]:
        """(offset, bytes) of elements first .. first + count, in the variable's order."""
        size = self.type.itemsize
        if not self.stride:
            yield self.begin + first * size, count * size
            return
        one = math.prod(self.shape[1:])
        while count > 0:
            record, at = divmod(first, one)
            n = min(count, one - at)
            yield self.begin + record * self.stride + at * size, n * size
            first, count = first + n, count - n


def parse(raw: bytes) -> tuple[dict, dict[str, Variable]]:
    """Global attributes and variables of a header; IndexError or struct.error if it goes on beyond raw."""
    if raw[:4] == b"\x89HDF":
        raise ValueError("NetCDF-4 (HDF5) file: convert it to a classic format first, e.g. by nccopy -k cdf5")
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    version, at = raw[3], 4

    def number(wide: bool) -> int:
        nonlocal at
        (v,) = struct.unpack_from(">Q" if wide else ">I", raw, at)
        at += 8 if wide else 4
        return v

    count = lambda: number(version == 5)

    def chunk(size: int) -> bytes:
        nonlocal at
        if at + size > len(raw):
            raise IndexError("header")
        out = raw[at : at + size]
        at += -(-size // 4) * 4
        return out

    def attributes() -> dict:
        number(False)
        out = {}
        for _ in range(count()):
            name, kind = chunk(count()).decode(), number(False)
            t = np.dtype(_TYPES[kind])
            a = np.frombuffer(chunk(count() * t.itemsize), t)
            out[name] = a.tobytes().decode(errors="replace").rstrip("\0") if kind == 2 else (a[0].item() if len(a) == 1 else a.tolist())
        return out

    records = count()
    number(False)
    dims = [(chunk(count()).decode(), count()) for _ in range(count())]
    every = attributes()
    number(False)
    listed = []
    for _ in range(count()):
        name = chunk(count()).decode()
        axes = [count() for _ in range(count())]
        listed.append((name, axes, attributes(), np.dtype(_TYPES[number(False)]), count(), number(version != 1)))
    recorded = [v for v in listed if v[1] and not dims[v[1][0]][1]]
    step = sum(v[4] for v in recorded)
    if len(recorded) == 1:  # a single record variable is not padded
        step = math.prod(dims[d][1] for d in recorded[0][1][1:]) * recorded[0][3].itemsize
    shape = lambda axes: [dims[d][1] or records for d in axes]
    return every, {n: Variable([dims[d][0] for d in axes], shape(axes), attrs, t, begin, step if axes and not dims[axes[0]][1] else 0) for n, axes, attrs, t, _, begin in listed}


def header(read: Callable[[int, int], bytes]) -> tuple[dict, dict[str, Variable]]:
    """The header of a file; read: (offset, bytes) -> bytes. A longer part is read until it is whole."""
    size = _HEAD
    while True:
        raw = read(0, size)
        try:
            return parse(raw)
        except (IndexError, struct.error) as e:
            if len(raw) < size:
                raise ValueError("a NetCDF header that ends early") from e
            size *= 8


def elements(read: Callable[[int, int], bytes], v: Variable, first: int = 0, count: int | None = None) -> np.ndarray:
    count = math.prod(v.shape) - first if count is None else count
    raw = b"".join(read(a, n) for a, n in v.ranges(first, count))
    if len(raw) < count * v.type.itemsize:
        raise ValueError("a NetCDF file that ends early")
    return np.frombuffer(raw, v.type)


def read_netcdf(raw: bytes) -> dict:
    """Attributes and arrays of a whole classic file."""
    read = lambda a, n: raw[a : a + n]
    attrs, variables = parse(raw)
    return {"attrs": attrs, "variables": {n: {"dims": v.dims, "attrs": v.attrs, "values": elements(read, v).reshape(v.shape)} for n, v in variables.items()}}


def write_netcdf(variables: dict[str, tuple[list[str], np.ndarray, dict]], record: str | None = None, version: int = 1) -> bytes:
    """A classic file; variables: (dimension names, values, text or number attributes). record: the dimension without a fixed length."""
    dims: dict[str, int] = {}
    for names, a, _ in variables.values():
        dims |= dict(zip(names, a.shape, strict=True))
    order, n = list(dims), ">Q" if version == 5 else ">I"
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(n, len(s.encode())) + pad(s.encode())
    kinds = {np.dtype(t): k for k, t in _TYPES.items() if k in (3, 4, 5, 6)}
    data = {v: a.astype(a.dtype.newbyteorder(">")) if a.dtype.newbyteorder(">") in kinds else a.astype(">f8") for v, (_, a, _) in variables.items()}

    def attributes(d: dict, like: np.dtype) -> bytes:
        out = struct.pack(">I", 12 if d else 0) + struct.pack(n, len(d))
        for k, v in d.items():
            kind, body = (2, v.encode()) if isinstance(v, str) else (kinds[t := like if k == "_FillValue" else np.dtype(">f8")], np.array(v, t).tobytes())
            out += name(k) + struct.pack(">I", kind) + struct.pack(n, len(body) // np.dtype(_TYPES[kind]).itemsize) + pad(body)
        return out

    recorded = [v for v, (names, _, _) in variables.items() if names and names[0] == record]
    size = {v: math.prod(a.shape[1:] if v in recorded else a.shape) * a.itemsize for v, a in data.items()}
    if len(recorded) > 1 or not recorded:
        size |= {v: -(-s // 4) * 4 for v, s in size.items()}
    records = dims[record] if record else 0
    head = b"CDF" + bytes([version]) + struct.pack(n, records) + struct.pack(">I", 10) + struct.pack(n, len(dims))
    head += b"".join(name(d) + struct.pack(n, 0 if d == record else k) for d, k in dims.items()) + attributes({}, np.dtype(">f8"))
    rows = {v: name(v) + struct.pack(n, len(names)) + b"".join(struct.pack(n, order.index(d)) for d in names) + attributes(attrs, data[v].dtype) + struct.pack(">I", kinds[data[v].dtype]) + struct.pack(n, -(-size[v] // 4) * 4) for v, (names, _, attrs) in variables.items()}
    out, where = head + struct.pack(">I", 11) + struct.pack(n, len(rows)), ">I" if version == 1 else ">Q"
    at, begins = len(out) + sum(len(r) + struct.calcsize(where) for r in rows.values()), {}
    for v in [*(v for v in rows if v not in recorded), *recorded]:
        begins[v] = at
        at += -(-size[v] // 4) * 4 if v not in recorded else size[v]
    out += b"".join(r + struct.pack(where, begins[v]) for v, r in rows.items())
    out += b"".join(pad(data[v].tobytes()) for v in rows if v not in recorded)
    for k in range(records):
        out += b"".join(data[v][k : k + 1].tobytes().ljust(size[v], b"\0") for v in recorded)
    return out


def dates(values: np.ndarray, units: str, calendar: str) -> list[date]:
    """Dates of times by a file's units ("days since 2000-01-01") and calendar."""
    m = re.match(r"(\w+?)s? since (\d+)-(\d+)-(\d+)", units)
    scale = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}[m[1]]
    first = date(*(int(m[k]) for k in (2, 3, 4)))
    if calendar not in ("noleap", "365_day"):
        return [first + timedelta(days=float(v) * scale) for v in values]
    start = first.timetuple().tm_yday - 1 - int(first.month > 2 and first.year % 4 == 0 and (first.year % 100 != 0 or first.year % 400 == 0))
    out = []
    for v in values:
        years, d = divmod(start + math.floor(v * scale), 365)
        k = int(np.searchsorted(_MONTHS, d, side="right"))
        out.append(date(first.year + years, k + 1, d - (int(_MONTHS[k - 1]) if k else 0) + 1))
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _File:
    """Range reads of a file; a context."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)

    def __enter__(self):
        return self.read

    def __exit__(self, *_):
        self.file.close()

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)


def _axis(variables: dict[str, Variable], names: tuple[str, ...]) -> str | None:
    return next((n for n in variables if n.lower() in names), None)


@dataclass
class Slab(InputPartition):
    uri: str
    variable: str
    steps: list[tuple[int, date]]
    levels: list[tuple[int | None, float | None]]  # place on the level axis, and its name

    def __post_init__(self):
        super().__init__((self.uri, self.variable))


_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values, IsNotNull: lambda x, _: True}


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"], names
        listed = lambda k: [v.strip() for v in options[k].split(",")] if options.get(k) else None
        self.variables, self.levels = listed("variable"), listed("levels")
        self.steps = int(options.get("steps", 0))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of date, level and variable are all done here; Spark need not repeat them."""
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("date", "level", "variable") and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, column: str, value) -> bool:
        return all(value is not None and _TESTS[t](value, v) for c, t, v in self.filters if c == column)

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            files = [self.path]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = sorted(self.path.rstrip("/") + i.path[len(root.rstrip("/")) :] for i in found if i.is_file and i.path.endswith(".nc"))
        with ThreadPoolExecutor(16) as pool:  # headers only
            out = [s for slabs in pool.map(self._slabs, files) for s in slabs]
        return out or [Slab(self.path, "", [], [])]

    def _slabs(self, uri: str) -> list[Slab]:
        out = []
        with _File(uri) as read:
            _, variables = header(read)
            lat, lon, time = (_axis(variables, n) for n in (_LAT, _LON, _TIME))
            days = None
            for name, v in variables.items():
                if not {lat, lon, time} <= set(v.dims) or self.variables and name not in self.variables or not self._wanted("variable", name):
                    continue
                if days is None:
                    t = variables[time]
                    days = dates(elements(read, t).astype(float), t.attrs["units"], t.attrs.get("calendar", "standard"))
                axis = next((d for d in v.dims if d not in (lat, lon, time)), None)
                levels: list[tuple[int | None, float | None]] = [(None, None)]
                if axis:
                    there = elements(read, variables[axis]).astype(float) * _LEVEL_UNITS.get(variables[axis].attrs.get("units", "Pa"), 1.0)
                    levels = [(int(np.abs(there - float(w)).argmin()), float(w)) for w in self.levels] if self.levels else list(enumerate(there.tolist()))
                levels = [x for x in levels if self._wanted("level", x[1])]
                steps = [(k, d) for k, d in enumerate(days) if self._wanted("date", d)]
                size = self.steps or max(1, SLAB // max(1, math.prod(v.shape) // max(1, len(days))))
                out += [Slab(uri, name, steps[a : a + size], levels) for a in range(0, len(steps) if levels else 0, size)]
        return out

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.steps:
            return
        with _File(partition.uri) as read:
            _, variables = header(read)
            v = variables[partition.variable]
            lat, lon, time = (_axis(variables, n) for n in (_LAT, _LON, _TIME))
            lats, lons = (elements(read, variables[n]).astype(float) for n in (lat, lon))
            axis = next((d for d in v.dims if d not in (lat, lon, time)), None)
            y, x = (a.ravel() for a in np.meshgrid(np.arange(len(lats), dtype=np.int32), np.arange(len(lons), dtype=np.int32), indexing="ij"))
            plain = v.dims == [d for d in (time, axis, lat, lon) if d]
            whole = None if plain else np.transpose(elements(read, v).reshape(v.shape), [v.dims.index(d) for d in (time, axis, lat, lon) if d])
            held: list[dict[str, np.ndarray]] = []
            for k, d in partition.steps:
                for at, level in partition.levels:
                    if plain:
                        values = elements(read, v, (k * v.shape[1] + at if axis else k) * len(y), len(y))
                    else:
                        values = (whole[k, at] if axis else whole[k]).ravel()
                    held.append({"y": y, "x": x, "value": _unpacked(values, v.attrs), "level": level, "date": d})
                    if len(held) * len(y) >= _ROWS:
                        yield self._batch(partition, held, lats, lons)
                        held = []
            if held:
                yield self._batch(partition, held, lats, lons)

    def _batch(self, p: Slab, held: list[dict], lats: np.ndarray, lons: np.ndarray) -> pa.RecordBatch:
        n = len(held[0]["y"])
        join = lambda c: np.concatenate([h[c] for h in held])
        columns = {
            "path": lambda: pa.array([p.uri] * (n * len(held)), pa.string()), "variable": lambda: pa.array([p.variable] * (n * len(held)), pa.string()),
            "y": lambda: pa.array(join("y")), "x": lambda: pa.array(join("x")), "lat": lambda: pa.array(lats[join("y")]), "lon": lambda: pa.array(lons[join("x")]),
            "level": lambda: pa.array([h["level"] for h in held for _ in range(n)], pa.float64()), "date": lambda: pa.array([h["date"] for h in held for _ in range(n)], pa.date32()),
            "value": lambda: pa.array(join("value"), from_pandas=True),
        }
        return pa.RecordBatch.from_arrays([columns[c]() for c in self.names], self.names)


def _unpacked(values: np.ndarray, attrs: dict) -> np.ndarray:
    out = values.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        if name in attrs:
            out[np.isin(values, np.asarray(attrs[name], values.dtype))] = np.nan
    return out * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)


class NetCdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return "path string, variable string, y int, x int, lat double, lon double, level double, date date, value double"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    """Make the format "netcdf" known to the session, and let filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetCdf)
