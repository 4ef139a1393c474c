"""Byte files in the shared folder, opened by executors through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path for a uri of Spark's."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), uri


class AtomicFile:
    """Writes under a name of its own and moves into place when closed, so a repeated task replaces whole files only."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which the data begin."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


class RangeReader:
    """Reads byte ranges of a file."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.file = self.fs.open_input_file(self.path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()
