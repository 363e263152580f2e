"""Binary files in the cluster's shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it for ``file:``, ``hdfs:``, ``s3:`` and like addresses or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        uri = "file://" + uri[5:].lstrip("/").join(("/", ""))
    return pafs.FileSystem.from_uri(uri)


def attempt_name(part: int, suffix: str) -> str:
    """A file name of this attempt alone.  Spark commits the rows of one attempt of each task, so files of lost or
    repeated attempts are never referred to."""
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(folder: str, name: str) -> pa.NativeFile:
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{name}")


def open_read(folder: str, name: str) -> pa.NativeFile:
    """Memory-mapped where the file is local, else random access by range reads."""
    fs, path = opened(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(f"{path}/{name}")
    return fs.open_input_file(f"{path}/{name}")
