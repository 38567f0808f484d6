"""File access shared by the Python data sources (local, HDFS or object store)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import InputPartition

SPLIT_BYTES = 64 << 20


def resolve(path: str):
    """(filesystem, path on it); a plain path is local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Sorted (path, size) of one file, or of all files below a folder."""
    filesystem, root = resolve(path)
    info = filesystem.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: len(path) - len(root)] if "://" in path and path.endswith(root) else ""
    if info.type == pafs.FileType.File:
        return [(scheme + info.path, info.size)]
    found = filesystem.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(
        (scheme + f.path, f.size)
        for f in found
        if f.type == pafs.FileType.File
        and f.path.endswith(suffix)
        and not any(part[:1] in "._" for part in f.path[len(root):].split("/") if part)
    )


@dataclass
class FileSplit(InputPartition):
    """A byte range of one file."""

    path: str
    start: int
    end: int
    size: int


def byte_splits(files, unit: int = 1, target: int = SPLIT_BYTES) -> list[FileSplit]:
    """Cut files into ranges that start at multiples of ``unit``."""
    step = max(unit, target // unit * unit)
    return [
        FileSplit(path, at, min(at + step, size), size)
        for path, size in files
        for at in range(0, size, step)
    ]
