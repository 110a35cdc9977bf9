"""Files in the shared folder, read and written from tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A name no other attempt of a task has, so that a repeated task never writes into a file that is being read."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


class Ranges:
    """Range reads of files below one folder; the last few files stay open."""

    def __init__(self, folder: str, most: int = 32):
        self.fs, self.root = open_fs(folder)
        self.open, self.most = {}, most

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        f = self.open[name]
        f.seek(offset)
        return f.read(length)


def batches_of(folder: str, columns: list[str], rows: int = 1024) -> Iterator[pa.Table]:
    """The rows of a Parquet table in the shared folder, some at a time, file after file."""
    fs, root = open_fs(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda x: x.path):
        if info.is_file and info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(rows, columns=columns):
                    yield pa.Table.from_batches([batch])
