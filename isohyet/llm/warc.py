"""WARC archives with revisit records and a two-level capture index.

Writing: each task writes one archive, a gzip member a record, after a warcinfo record. Of records with equal payloads of
at least `smallest` bytes the one with the largest id is a response, the others are revisits of it; which is decided by one
row a payload, joined back by plain exchanges that Spark splits where one payload is a third of all rows. A response's
block is an HTTP response with the payload, a revisit's its head alone. Record ids are UUIDs (version 8) that hold the
page's id beside a hash of payload and URL, so a revisit can name its response, and a reader the page.
Captures (sort key, file, offset, length) are sorted by reversed-host URL key over all archives; ranges of them become
files of gzip blocks of BLOCK lines, and the directory keeps one row a block: its first and last key, file, offset, length.

Reading: search takes keys. The index files' ranges (one row for some RANGE captures) are a list in which a task finds
a key's files by binary search; a file's keys meet its part of the directory, where binary search finds their blocks;
each block is read as one range and its lines found by binary search; records are read as ranges, in order of archive
and offset, by as many tasks as their bytes ask for. read_all wants every record and goes over all blocks instead.

Each attempt writes files of its own name, and captures and directory are tables in the shared folder, so a task that
runs again leaves at worst a file that nothing refers to.

Defined results: a null payload is empty; a null URL has an empty key, and no-uri for its target. Repeated ids are separate
records; of equal payloads with the same largest id each of these is a response. A null id is never the one referred to
unless alone. Rows equal in id, URL and payload are one capture written again and share a record id.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import math
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import cut, release, scratch
from .storage import Ranges, attempt_name, open_fs

#: Index lines in a block; captures in an index file, roughly.
BLOCK, RANGE = 256, 50_000
#: Bytes of records that a task reads.
READ = 32 << 20
_CAPTURES = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])
_RECORDS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def sort_key(url: Column) -> Column:
    """The host's labels reversed and joined by commas, ")", then the rest: com,example,www)/path. Hosts in lower case; tabs and line ends as percent codes."""
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    surt = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    key = F.coalesce(F.concat(surt, F.lit(")"), F.substr(rest, F.length(host) + 1)), F.lit(""))
    for sign, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(sign), F.lit(code))
    return key


def decide(pages: DataFrame, smallest: int) -> DataFrame:
    """pages (id, url, html) with digest, bytes and, null for responses, refers_to and refers_url."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    known = pages.select("id", "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    large = pages.select("id", F.coalesce("url", F.lit("")).alias("url"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= smallest)
    groups = large.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("o"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select(F.col("digest").alias("d"), F.col("o.id").alias("original"), F.col("o.url").alias("original_url")), "warc-groups")
    joined = known.join(groups, (known["digest"] == groups["d"]) & (known["bytes"] >= smallest), "left")
    other = F.coalesce(F.col("id") != F.col("original"), F.col("original").isNotNull())
    return joined.select("id", "url", "html", "digest", "bytes", F.when(other, F.col("original")).alias("refers_to"), F.when(other, F.col("original_url")).alias("refers_url"))


def record_id(page: int | None, url: str, digest: str) -> str:
    """A version 8 UUID: the page's 64 bits, whether there is one, and 57 bits of a hash of payload and URL."""
    p = (page or 0) & (1 << 64) - 1
    h = int.from_bytes(hashlib.sha1(f"{digest} {url}".encode()).digest()[:8], "big") >> 7
    return f"<urn:uuid:{uuid.UUID(int=(p >> 16) << 80 | 8 << 76 | (p >> 4 & 0xFFF) << 64 | 2 << 62 | (p & 15) << 58 | (page is None) << 57 | h)}>"


def page_of(name: str) -> int | None:
    """The page's id in a record id."""
    x = uuid.UUID(name.removeprefix("<urn:uuid:").removesuffix(">")).int
    p = (x >> 80) << 16 | (x >> 64 & 0xFFF) << 4 | x >> 58 & 15
    return None if x >> 57 & 1 else p - (p >> 63 << 64)


#: Line ends in a URL are written as their percent codes; what stands for no URL.
_LINE, _NO_URI = {10: "%0A", 13: "%0D"}, "urn:no-uri"


def _target(url: str) -> str:
    return url.translate(_LINE) or _NO_URI


def _written(fields: list[tuple[str, str]], block: bytes) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n").encode() + block + b"\r\n\r\n"


def _record(page: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, url, digest)), ("WARC-Date", date), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, refers_url or "", digest)), ("WARC-Refers-To-Target-URI", _target(refers_url or "")), ("WARC-Refers-To-Date", date), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _written(fields, head + (payload if refers_to is None else b""))


def _info(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _written(fields, b"software: isohyet\r\nformat: WARC File Format 1.1\r\n")


def headers(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, named fields and what follows of a record or an HTTP response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse_record(raw: bytes) -> dict:
    """What a response or revisit record says; a payload's digest is checked."""
    _, h, rest = headers(raw)
    _, http, payload = headers(rest[: int(h["Content-Length"])])
    digest, whole, url = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "response", h["WARC-Target-URI"]
    if whole and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {h['WARC-Record-ID']}: the payload does not have its digest")
    refers_to = page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
    return {"id": page_of(h["WARC-Record-ID"]), "url": "" if url == _NO_URI else url, "record_type": h["WARC-Type"], "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "refers_to": refers_to, "payload": payload if whole else None}


def _write_archives(folder: str, date: str):
    def run(batches):
        fs, root = open_fs(folder)
        name, out, at = attempt_name("archive", ".warc.gz"), None, 0
        for b in batches:
            rows = []
            for key, page, url, html, digest, size, refers, refers_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    at = out.write(gzip.compress(_info(name, date), 6, mtime=0))
                packed = gzip.compress(_record(page, url or "", (html or "").encode(), digest, size, refers, refers_url, date), 6, mtime=0)
                out.write(packed)
                rows.append((key, page, name, at, len(packed)))
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CAPTURES.types, strict=True)] if rows else [pa.array([], t) for t in _CAPTURES.types], schema=_CAPTURES)
        if out is not None:
            out.close()

    return run


def _write_index(folder: str):
    def run(batches):
        fs, root = open_fs(folder)
        name, out, at, held = attempt_name("index", ".cdx.gz"), None, 0, []

        def block():
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            lines = "".join("\t".join(("" if x is None else str(x)) for x in r) + "\n" for r in held)
            packed = gzip.compress(lines.encode(), 6, mtime=0)
            out.write(packed)
            row = pa.RecordBatch.from_pylist([{"first_key": held[0][0], "last_key": held[-1][0], "file": name, "offset": at, "length": len(packed), "lines": len(held)}], schema=_DIRECTORY)
            at += len(packed)
            held.clear()
            return row

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(r)
                if len(held) == BLOCK:
                    yield block()
        if held:
            yield block()
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, folder: str, smallest: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Write archives and capture index below folder, which tasks can reach; returns the directory of the index, a table. date: the records' (UTC), now if none."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    pages = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = decide(pages, smallest).select(sort_key(F.col("url")).alias("key"), "id", "url", "html", "digest", "bytes", "refers_to", "refers_url")
    captures = cut(rows.mapInArrow(_write_archives(folder, date), "key string, id long, file string, offset long, length long"), "warc-captures")
    ranges = max(1, -(-captures.count() // RANGE), spark.sparkContext.defaultParallelism)
    ordered = captures.repartitionByRange(ranges, "key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
    directory = cut(ordered.mapInArrow(_write_index(folder), "first_key string, last_key string, file string, offset long, length long, lines long"), "warc-directory")
    release(captures)
    return directory


def _lines(ranges: Ranges, file: str, offset: int, length: int) -> list[list[str]]:
    return [x.split("\t") for x in gzip.decompress(ranges.read(file, offset, length)).decode().split("\n")[:-1]]


_PLACES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _places(lines: list[list[str]]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(([x[2] for x in lines], [int(x[3]) for x in lines], [int(x[4]) for x in lines]), _PLACES.types, strict=True)], schema=_PLACES)


def fetch(places: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at places (file, offset, length), read in order of archive and offset."""
    places = cut(places, "warc-places")
    size = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(math.ceil(size / READ), places.sparkSession.sparkContext.defaultParallelism)
    dealt = places.repartition(tasks, "file", F.floor(F.col("offset") / (READ // 4))).sortWithinPartitions("file", "offset")

    def run(batches):
        archives = Ranges(folder)
        for b in batches:
            held, some = 0, []
            for name, at, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = parse_record(zlib.decompress(archives.read(name, at, length), 31))
                held += len(r["payload"] or b"")
                some.append(r if payloads else r | {"payload": None})
                if payloads and held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(some, schema=_RECORDS)
                    held, some = 0, []
            yield pa.RecordBatch.from_pylist(some, schema=_RECORDS)

    return dealt.mapInArrow(run, "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def read_all(directory: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record that the index knows: id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""

    def run(batches):
        ranges = Ranges(folder)
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _places(_lines(ranges, file, offset, length)).to_batches()

    blocks = directory.select("file", "offset", "length")
    return fetch(blocks.mapInArrow(run, "file string, offset long, length long"), folder, payloads)


def spans(keys: list[tuple[str, str]], key: str) -> range:
    """Which of the sorted ranges (first, last key) can hold key, by two binary searches."""
    return range(bisect.bisect_left(keys, key, key=lambda x: x[1]), bisect.bisect_right(keys, key, key=lambda x: x[0]))


def _in_file(folder: str):
    def run(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        """Places of the records of keys that one index file may hold."""
        blocks = blocks.sort_by("offset")
        at = list(zip(blocks["first_key"].to_pylist(), blocks["last_key"].to_pylist(), strict=True))
        ranges, found, open_, lines, names = Ranges(folder), [], -1, [], []
        for key in sorted(wanted["key"].to_pylist()):
            for k in spans(at, key):
                if k != open_:
                    b = blocks.slice(k, 1).to_pylist()[0]
                    open_, lines = k, _lines(ranges, b["file"], b["offset"], b["length"])
                    names = [x[0] for x in lines]
                found += lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
        return _places(found)

    return run


def search(directory: DataFrame, folder: str, keys: DataFrame, payloads: bool = True) -> DataFrame:
    """The records whose sort key is one of keys (key, each counts once); columns as in read_all. A key that no capture has gives none."""
    files = directory.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    files = sorted((r["low"], r["high"], r["file"]) for r in files)
    at = [f[:2] for f in files]

    def assign(batches):
        for b in batches:
            pairs = [(files[k][2], key) for key in b["key"].to_pylist() for k in spans(at, key)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["file", "key"])

    wanted = keys.select("key").where("key is not null").distinct().mapInArrow(assign, "file string, key string")
    blocks = directory.select("file", "first_key", "last_key", "offset", "length")
    places = wanted.groupBy("file").cogroup(blocks.groupBy("file")).applyInArrow(_in_file(folder), "file string, offset long, length long")
    return fetch(places, folder, payloads)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of pages in the shared folder; every page's URL is then searched in their index, and the records read without the payloads."""
    folder = scratch(spark, "warc-archives")
    return search(write(pages, folder), folder, pages.select(sort_key(F.col("url")).alias("key")), payloads=False)
