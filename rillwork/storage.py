"""File access inside tasks, for opaque files that Spark's writers do not name or encode."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyarrow import fs

CHUNK = 8 << 20
# Window bits that select the container of the deflate codec.
WINDOW_BITS = {"gzip": 31, "zlib": 15}


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style URI (``file:/a``, ``s3a://b/c``, ``hdfs://h/p``, ``/a``)."""
    match = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)$", uri)
    if match is None or match.group(1) == "file":
        return fs.LocalFileSystem(), match.group(3) if match else uri
    scheme, authority, path = match.groups()
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return system, f"{root.rstrip('/')}{path}"


def read_chunks(uri: str) -> Iterator[bytes]:
    system, path = open_path(uri)
    with system.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def deflated(chunks: Iterable[bytes], codec: str) -> Iterator[bytes]:
    packer = zlib.compressobj(wbits=WINDOW_BITS[codec])
    for chunk in chunks:
        yield packer.compress(chunk)
    yield packer.flush()


def inflated(chunks: Iterable[bytes], codec: str) -> Iterator[bytes]:
    opener = zlib.decompressobj(wbits=WINDOW_BITS[codec])
    for chunk in chunks:
        yield opener.decompress(chunk)
        while opener.eof and opener.unused_data:
            rest = opener.unused_data
            opener = zlib.decompressobj(wbits=WINDOW_BITS[codec])
            yield opener.decompress(rest)
    yield opener.flush()


class PartFile:
    """A file that is written under a name of its own and appears under the given one when it is closed."""

    def __init__(self, uri: str):
        self.system, self.path = open_path(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.size = self.system.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> int:
        self.out.close()
        self.system.move(self.part, self.path)
        return self.size


def move(source: str, target: str) -> None:
    """Give a file its final name; a task that runs again finds it moved, and leaves it so."""
    system, old = open_path(source)
    _, new = open_path(target)
    system.create_dir(new.rsplit("/", 1)[0], recursive=True)
    kinds = [info.type for info in system.get_file_info([old, new])]
    if kinds != [fs.FileType.NotFound, fs.FileType.File]:
        system.move(old, new)


def read_range(uri: str, start: int, length: int) -> Iterator[bytes]:
    """A stretch of a file, chunk by chunk."""
    system, path = open_path(uri)
    with system.open_input_file(path) as file:
        file.seek(start)
        while length > 0 and (chunk := file.read(min(CHUNK, length))):
            length -= len(chunk)
            yield chunk


def write_chunks(uri: str, chunks: Iterable[bytes], append: bool = False) -> int:
    """Write a file and return the bytes written.

    The bytes go to a name of their own first and are then moved, so a task that runs twice or dies
    half way never leaves a torn or doubled file.
    """
    system, path = open_path(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    written = 0
    with system.open_output_stream(part, compression=None) as out:
        if append and system.get_file_info(path).type == fs.FileType.File:
            for chunk in read_chunks(uri):
                out.write(chunk)
        for chunk in chunks:
            out.write(chunk)
            written += len(chunk)
    system.move(part, path)
    return written
