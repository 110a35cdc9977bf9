"""GeoTIFF bands without any library: strips or tiles, chunky or planar, with no compression, LZW, Deflate or PackBits and both predictors."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np

#: Fixed values of the format: sample types by (format, bits), field types by code, compressions.
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773
COMPRESSIONS = {"none": _NONE, "lzw": _LZW, "deflate": _DEFLATE, "packbits": _PACKBITS}
_CLEAR, _END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits from the highest bit on, widened one code early."""
    out, table, last = bytearray(), [], b""
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _CLEAR:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == _END:
            break
        if not table:
            raise ValueError("LZW data without a first clear code")
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code beyond its table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(_CLEAR)
    table, size, word = {bytes([k]): k for k in range(256)}, 258, b""
    for k in data:
        longer = word + bytes([k])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], size, word = size, size + 1, longer[-1:]
        width = max(9, size.bit_length())
        if size == 4094:
            put(_CLEAR)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
    if word:
        put(table[word])
        width = min(12, max(9, (size + 1).bit_length()))
    put(_END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, plain = bytearray(), bytearray()
    for byte, run in ((k, len(list(g))) for k, g in itertools.groupby(data)):
        while run:
            n = min(run, 128)
            run -= n
            if n > 2:
                out += b"".join(bytes([len(c) - 1]) + c for c in (plain[a : a + 128] for a in range(0, len(plain), 128)))
                plain = bytearray()
                out += bytes([257 - n, byte])
            else:
                plain += bytes([byte]) * n
    return bytes(out + b"".join(bytes([len(c) - 1]) + c for c in (plain[a : a + 128] for a in range(0, len(plain), 128))))


def _decompress(data: bytes, how: int) -> bytes:
    if how == _NONE:
        return data
    if how == _LZW:
        return lzw_decode(data)
    if how in (_DEFLATE, _OLD_DEFLATE):
        return zlib.decompress(data)
    if how == _PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"TIFF compression {how}")


def _unpredict(raw: bytes, rows: int, cols: int, samples: int, kind: np.dtype, how: int) -> np.ndarray:
    """A block of (rows, cols, samples) from its bytes, differences between neighbours added up."""
    if how == 3:  # bytes of floats by significance, then differences of bytes
        b = np.frombuffer(raw, np.uint8, rows * cols * samples * kind.itemsize).reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8)
        planes = b.reshape(rows, kind.itemsize, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(kind.newbyteorder(">")).reshape(rows, cols, samples)
    a = np.frombuffer(raw, kind, rows * cols * samples).reshape(rows, cols, samples)
    if how == 2:
        if kind.kind == "f":
            u = np.dtype(f"{kind.byteorder}u{kind.itemsize}")
            return a.view(u).cumsum(axis=1, dtype=f"u{kind.itemsize}").view(f"f{kind.itemsize}")
        return a.cumsum(axis=1, dtype=kind.newbyteorder("="))
    if how != 1:
        raise ValueError(f"TIFF predictor {how}")
    return a


def _predict(a: np.ndarray, how: int) -> bytes:
    if how == 1:
        return a.tobytes()
    if how == 2:
        u = a.view(f"<u{a.itemsize}")
        return np.concatenate([u[:, :1], np.diff(u, axis=1)], axis=1).tobytes()
    planes = a.astype(a.dtype.newbyteorder(">")).reshape(len(a), -1).view(np.uint8).reshape(len(a), -1, a.itemsize).transpose(0, 2, 1)
    b = np.ascontiguousarray(planes).reshape(len(a), -1, a.shape[2])
    return np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).tobytes()


def tags_of(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    end, at = "<" if raw[:2] == b"II" else ">", 0
    (at,) = struct.unpack_from(end + "I", raw, 4)
    tags = {}
    for k in range(struct.unpack_from(end + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * k)
        if kind in _FIELDS:
            where = at + 10 + 12 * k
            if struct.calcsize(_FIELDS[kind]) * n > 4:
                (where,) = struct.unpack_from(end + "I", raw, where)
            tags[tag] = struct.unpack_from(f"{end}{n}{_FIELDS[kind]}", raw, where)
    return end, tags


def read_tiff(raw: bytes, band: int = 1) -> tuple[np.ndarray, dict]:
    """One band (from 1), with origin and pixel size; an error if the band is missing. Only that band's blocks are decoded where bands are planar."""
    end, tags = tags_of(raw)
    width, height, count = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    if not 1 <= band <= count:
        raise ValueError(f"band {band} of {count}")
    kind = np.dtype(end + _SAMPLES[tags.get(339, (1,))[0], tags[258][0]])
    how, predictor, planar = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0] == 2
    tiled = 322 in tags
    h, w = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (height,))[0], height), width)
    across, down, samples = -(-width // w), -(-height // h), 1 if planar else count
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.empty((height, width), kind.newbyteorder("="))
    first = (band - 1) * across * down if planar else 0
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)  # a tile is whole, a last strip is not
        data = _decompress(raw[offsets[first + k] : offsets[first + k] + sizes[first + k]], how)
        block = _unpredict(data, rows, w, samples, kind, predictor)[:, :, 0 if planar else band - 1]
        out[y : y + h, x : x + w] = block[: height - y, : width - x]
    return out, {"pixel": tags.get(33550, (1.0, 1.0, 0.0))[:2], "origin": tags.get(33922, (0.0,) * 6)[3:5]}


def write_tiff(values: np.ndarray, lats: np.ndarray, lons: np.ndarray, compression: str = "none", predictor: int = 1, tile: int = 0, planar: bool = False, rows: int = 0) -> bytes:
    """A GeoTIFF in geographic coordinates (EPSG:4326) of (y, x) or (y, x, band); cells' sizes and edges follow from the centres. lats run from north.

    Float64 becomes float32, integers keep their type. tile: side of a tile, a multiple of 16; else strips of `rows` rows, or one.
    """
    a = values[:, :, None] if values.ndim == 2 else values
    a = a.astype("<f4") if a.dtype.kind == "f" else a.astype(a.dtype.newbyteorder("<"))
    height, width, count = a.shape
    dx, dy = (lons[-1] - lons[0]) / max(1, width - 1), (lats[0] - lats[-1]) / max(1, height - 1)
    h, w = (tile, tile) if tile else (rows or height, width)
    pack = {_NONE: bytes, _LZW: lzw_encode, _DEFLATE: zlib.compress, _PACKBITS: packbits_encode}[code := COMPRESSIONS[compression]]
    blocks = []
    for layer in [a[:, :, b : b + 1] for b in range(count)] if planar else [a]:
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = layer[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)), mode="edge")
                blocks.append(pack(_predict(np.ascontiguousarray(block), predictor)))
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b + b"\0" * (len(b) % 2)
    sizes = [len(b) for b in blocks]
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    keys = [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [a.itemsize * 8] * count), (259, 3, [code]), (262, 3, [1]), (277, 3, [count]), (284, 3, [2 if planar else 1]), (317, 3, [predictor]), (339, 3, [form] * count),
               (33550, 12, [dx, dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, lons[0] - dx / 2, lats[0] + dy / 2, 0.0]), (34735, 3, keys)]
    entries += [(322, 4, [w]), (323, 4, [h]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [h]), (279, 4, sizes)]
    at, table, extra = 8 + len(body), b"", b""
    extra_at = at + 2 + 12 * len(entries) + 4
    for tag, kind, v in sorted(entries):
        packed = struct.pack(f"<{len(v)}{_FIELDS[kind]}", *v)
        if len(packed) > 4:
            table += struct.pack("<HHII", tag, kind, len(v), extra_at + len(extra))
            extra += packed
        else:
            table += struct.pack("<HHI", tag, kind, len(v)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0) + extra
