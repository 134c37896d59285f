"""Files by URI, in tasks: list, open, write, move.

A path with a scheme (``s3://bucket/dir``, ``hdfs://host/dir``, ``file:/dir``)
is opened by Arrow's file systems; one without is a path of the machine, which
on a cluster must be a mount that all executors share.  Nothing here touches
the driver's disk unless the driver calls it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs


@dataclass(frozen=True)
class Entry:
    """One directory entry; ``size`` and ``target`` are asked for when needed."""

    path: str
    name: str
    is_dir: bool
    _stat: object = None
    length: int | None = None

    def size(self) -> int:
        return int(self._stat.stat().st_size) if self.length is None else self.length

    def target(self) -> str:
        """Where a link leads (the path itself otherwise)."""
        if self._stat is not None and self._stat.is_symlink():
            return os.path.realpath(self.path)
        return self.path


def is_local(uri: str) -> bool:
    return uri.startswith("file:") or not re.match("[a-z][a-z0-9+.-]*://", uri)


def local_path(uri: str) -> str:
    """Path of a ``file:`` URI or a plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return uri


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    if is_local(uri):
        return pafs.LocalFileSystem(), local_path(uri)
    return pafs.FileSystem.from_uri(uri)


def canonical(uri: str) -> str:
    """A root without links, relative parts and a closing slash."""
    return os.path.realpath(local_path(uri)) if is_local(uri) else uri.rstrip("/")


def entries(directory: str) -> Iterator[Entry]:
    """Entries of a directory, one by one.  Links to files are files, links to
    directories are left out, as are entries that are neither.  A directory
    that is closed or gone has none; any other error would lose a subtree and
    is raised."""
    if is_local(directory):
        try:
            found = os.scandir(local_path(directory))
        except (PermissionError, FileNotFoundError):
            return
        with found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield Entry(e.path, e.name, True)
                elif e.is_file():
                    yield Entry(e.path, e.name, False, e)
        return
    directory = directory.rstrip("/")
    system, path = resolve(directory)
    scheme = directory[:-len(path)] if directory.endswith(path) else directory[:directory.index("://") + 3]
    for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if info.type == pafs.FileType.Directory:
            yield Entry(scheme + info.path, info.base_name, True)
        elif info.type == pafs.FileType.File:
            yield Entry(scheme + info.path, info.base_name, False, length=int(info.size or 0))


def read_bytes(uri: str) -> bytes:
    system, path = resolve(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def write_bytes(uri: str, data: bytes) -> None:
    system, path = resolve(uri)
    with system.open_output_stream(path) as stream:
        stream.write(data)


def make_folder(uri: str) -> None:
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)


def exists(uri: str) -> bool:
    system, path = resolve(uri)
    return system.get_file_info(path).type != pafs.FileType.NotFound


def is_folder(uri: str) -> bool:
    system, path = resolve(uri)
    return system.get_file_info(path).type == pafs.FileType.Directory


def move(source: str, target: str) -> None:
    """Rename, taking the place of a file; a copy and a deletion where the
    store knows no renames."""
    system, path = resolve(source)
    system.move(path, resolve(target)[1])


def remove(uri: str) -> None:
    """Delete a file, if it is there."""
    system, path = resolve(uri)
    try:
        system.delete_file(path)
    except FileNotFoundError:
        pass


def remove_folder(uri: str) -> None:
    system, path = resolve(uri)
    try:
        system.delete_dir(path)
    except (FileNotFoundError, pa.ArrowInvalid):
        pass
