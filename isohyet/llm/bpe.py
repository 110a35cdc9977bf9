"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into leaves of bounded length; each leaf's encoding is an element: the ids between its first and its last
stable boundary, and the unsettled characters before and after. Neighbours are joined up a balanced tree: the window from
the left's last stable boundary to the right's first is re-encoded, the ids outside it are kept. A side without a
boundary settles nothing, so that the window grows over it, up the tree, until both of its ends are stable.

A boundary is stable where a letter is followed by neither letter, mark nor apostrophe, or a digit by no digit. No match
of the split patterns of the public byte-level vocabularies goes on across one, none before it looks beyond it, and no
pattern looks back, so the matches of both sides are those of the whole text. Each match is merged by the ranks on its
own, as the public tiktoken library does. Decoding concatenates the tokens' bytes up the tree.

Defined results: a null text is an empty one: no ids, no bytes. Ids are packed as little-endian unsigned 32-bit integers, or 16-bit ones where asked.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .runtime import trim

#: Characters of a leaf: about half of all documents of some hundred words are reduced over several.
LEAF = 1024


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The public library's encoder for a rank file, and each id's bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens


#: Positions that are stable boundaries.
_STABLE = regex.compile(r"(?<=\p{L})(?=[^\p{L}\p{M}'\u2019])|(?<=\p{N})(?=\P{N})")


class Element(NamedTuple):
    """The encoding of text[a:b]: packed ids of text[head:tail] in runs, both ends stable; head and tail are None where no boundary is."""

    a: int
    b: int
    head: int | None
    tail: int | None
    runs: list[bytes]


def _packed(text: str, encoding) -> bytes:
    """Packed ids; the call without special tokens does not look for them."""
    ids = encoding.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


def _boundaries(text: str, a: int, b: int) -> tuple[int, int] | None:
    """Two stable boundaries of text[a:b] next to its ends: the outermost spaces if both follow a letter or digit, else the first and the last of all."""
    head, tail = text.find(" ", a, b), text.rfind(" ", a, b)
    if 0 < head < tail and text[head - 1].isalnum() and text[tail - 1].isalnum():
        return head, tail
    if not (first := _STABLE.search(text, a, b)):
        return None
    width, last = 32, None
    while last is None:  # at the latest found where the first was
        for last in _STABLE.finditer(text, max(a, b - width), b):
            pass
        width *= 2
    return first.start(), last.start()


def leaf(text: str, a: int, b: int, encoding) -> Element:
    """What lies between the leaf's stable boundaries, encoded."""
    if not (ends := _boundaries(text, a, b)):
        return Element(a, b, None, None, [])
    return Element(a, b, *ends, [_packed(text[ends[0] : ends[1]], encoding)])


def join(text: str, x: Element, y: Element, encoding) -> Element:
    """x and y joined by re-encoding the window between their stable boundaries; it grows over a side that has none."""
    if x.head is None:
        return y._replace(a=x.a)
    if y.head is None:
        return x._replace(b=y.b)
    return Element(x.a, y.b, x.head, y.tail, [*x.runs, _packed(text[x.tail : y.head], encoding), *y.runs])


def _reduce(text: str, a: int, b: int, leaf_chars: int, encoding) -> Element:
    if b - a <= leaf_chars:
        return leaf(text, a, b, encoding)
    half = (a + b) // 2
    return join(text, _reduce(text, a, half, leaf_chars, encoding), _reduce(text, half, b, leaf_chars, encoding), encoding)


def encode_text(text: str, encoding, leaf_chars: int = LEAF) -> np.ndarray:
    """Ids of text. The ends of the whole text are stable too."""
    root = _reduce(text, 0, len(text), leaf_chars, encoding)
    if root.head is None:
        return np.frombuffer(_packed(text, encoding), "<u4")
    return np.frombuffer(b"".join([_packed(text[: root.head], encoding), *root.runs, _packed(text[root.tail :], encoding)]), "<u4")


def decode_ids(ids: list[int], tokens: list[bytes]) -> bytes:
    """The bytes of ids, halves concatenated up the tree."""
    if len(ids) <= 65_536:
        return b"".join([tokens[i] for i in ids])
    half = len(ids) // 2
    return decode_ids(ids[:half], tokens) + decode_ids(ids[half:], tokens)


def encode(df: DataFrame, text: str = "text", *, path: str, pattern: str, ids: str = "ids", decoded: str | None = None, leaf_chars: int = LEAF, width: int = 4) -> DataFrame:
    """df with the packed ids of column text in place of it; with `decoded`, also the bytes that the packed ids stand for, decoded in the same task.

    width: bytes of an id, 4 or 2; a vocabulary with larger ids than fit is refused.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    rest = [c for c in df.columns if c not in (text, ids, decoded)]
    df = df.select(*rest, F.coalesce(text, F.lit("")).alias(ids))

    def run(batches):
        encoding = codec(path, pattern)[0]
        if encoding.max_token_value >= 256**width:
            raise ValueError(f"ids up to {encoding.max_token_value} do not fit {width} bytes")
        for b in batches:
            packed = [encode_text(t.as_py(), encoding, leaf_chars).astype(kind).tobytes() for t in b[ids]]
            out = [*(b[c] for c in rest), pa.array(packed, pa.binary())]
            if decoded:
                tokens = codec(path, pattern)[1]
                out.append(pa.array([decode_ids(np.frombuffer(x, kind).tolist(), tokens) for x in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*rest, ids, *([decoded] if decoded else [])])
        trim()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest), f"`{ids}` binary", *([f"`{decoded}` binary"] if decoded else [])])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", *, path: str, pattern: str, decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the packed ids stand for; null ids stand for none. Bytes need not be whole UTF-8 for arbitrary ids."""
    rest = [c for c in df.columns if c != decoded]
    df = df.select(*rest)

    def run(batches):
        tokens = codec(path, pattern)[1]
        for b in batches:
            out = [decode_ids(np.frombuffer(x or b"", "<u4").tolist(), tokens) for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(out, pa.binary())], [*rest, decoded])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{decoded}` binary"])
    return df.mapInArrow(run, schema)
