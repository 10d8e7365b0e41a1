"""Binary files in shared folders, written and read in byte ranges by tasks.

Any store that pyarrow opens by address works (local or mounted folders, HDFS, S3, Google and Azure storage;
Spark's names of their schemes are understood). A file
is written under a name of its attempt and moved in place when complete, so a repeated or speculative
task replaces it by equal bytes and readers never see half a file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


#: Schemes as Spark writes them, and as pyarrow does.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def _open(address: str) -> tuple[fs.FileSystem, str]:
    scheme, mark, rest = address.partition("://")
    if mark and scheme in SCHEMES:
        address = f"{SCHEMES[scheme]}://{rest}"
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def write_file(address: str, data: bytes) -> None:
    store, path = _open(address)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    store.move(attempt, path)


def read_range(address: str, start: int, size: int) -> bytes:
    """At most `size` bytes from `start`; fewer at the end of the file."""
    store, path = _open(address)
    with store.open_input_file(path) as file:
        whole = file.size()
        return file.read_at(max(0, min(size, whole - start)), start) if start < whole else b""
