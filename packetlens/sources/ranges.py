"""Byte ranges of files that tasks can reach: local or mounted paths, and the stores that Arrow's file systems know (hdfs, s3, gs, file)."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs as arrow_fs


def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"not a path of a file system that executors see: {path}")
    return path


def _remote(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def reachable(path: str) -> bool:
    """Whether ranges of ``path`` can be read; stores that only Spark knows cannot."""
    if not is_remote(path):
        return True
    try:
        fs, inner = _remote(path)
        return fs.get_file_info(inner).type != arrow_fs.FileType.NotFound
    except Exception:  # noqa: BLE001  (an unknown scheme, a missing driver or no credentials: Spark's reader is asked instead)
        return False


def files_at(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files of a folder with one of the suffixes, or those of a glob or single path, in name order."""
    if is_remote(path):
        fs, inner = _remote(path)
        info = fs.get_file_info(inner)
        if info.type == arrow_fs.FileType.File:
            return [path]
        found = fs.get_file_info(arrow_fs.FileSelector(inner))
        names = [f.base_name for f in found if f.type == arrow_fs.FileType.File]
        return sorted(f"{path.rstrip('/')}/{n}" for n in names if n.endswith(suffixes) and n[0] not in "._")
    path = local_path(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(suffixes) and n[0] not in "._")
    return sorted(p for p in glob.glob(path) if os.path.isfile(p))


def file_size(path: str) -> int:
    if is_remote(path):
        fs, inner = _remote(path)
        return fs.get_file_info(inner).size
    return os.path.getsize(local_path(path))


def read_range(path: str, start: int, size: int | None = None) -> bytes:
    """``size`` bytes from ``start`` on, fewer at the file's end; all of the rest if not said."""
    if is_remote(path):
        fs, inner = _remote(path)
        with fs.open_input_file(inner) as f:
            return f.read_at(f.size() - start if size is None else min(size, f.size() - start), start)
    with open(local_path(path), "rb") as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


@contextmanager
def opened(path: str) -> Iterator[tuple[Callable[[int, int], bytes], int]]:
    """A function that reads so many bytes from an offset on, fewer at the file's end, and the file's size."""
    if is_remote(path):
        fs, inner = _remote(path)
        with fs.open_input_file(inner) as f:
            size = f.size()
            yield lambda start, n: f.read_at(max(0, min(n, size - start)), min(start, size)), size
        return
    with open(local_path(path), "rb") as f:

        def load(start: int, n: int) -> bytes:
            f.seek(start)
            return f.read(n)

        yield load, os.fstat(f.fileno()).st_size
