"""Files of the shared folder, read and written by workers through Arrow's file systems."""

from __future__ import annotations

import os

import numpy as np
from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def is_local(path: str) -> bool:
    """Whether a file is in a mounted folder, so that it can be mapped in place; paths without a scheme are."""
    return path.startswith("file:") or "://" not in path


def create(path: str):
    """A new file for writing; its folder is made."""
    where, name = resolve(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    return where.open_output_stream(name, compression=None)


def open_stream(path: str):
    """A file for sequential reading."""
    where, name = resolve(path)
    return where.open_input_stream(name, compression=None)


#: Bytes before an array: the name of its type.
HEAD = 16


def save(path: str, array: np.ndarray) -> None:
    """The array's type and bytes, little-endian, as a file."""
    array = np.ascontiguousarray(array, dtype=array.dtype.newbyteorder("<"))
    with create(path) as out:
        out.write(array.dtype.str.encode().ljust(HEAD))
        out.write(array.data)


def load(path: str) -> np.ndarray:
    """A file of ``save`` as an array.

    In a mounted folder it is mapped to memory, not read; from another store it
    is read whole, so that nothing is left on the worker's disk.
    """
    where, name = resolve(path)
    if not is_local(path):
        with where.open_input_stream(name, compression=None) as source:
            kind = source.read(HEAD).decode().strip()
            return np.frombuffer(source.read(), dtype=kind)
    with open(name, "rb") as source:
        kind = source.read(HEAD).decode().strip()
    # As a plain array, which is indexed faster.
    return np.asarray(np.memmap(name, dtype=kind, mode="r", offset=HEAD)) if os.path.getsize(name) > HEAD else np.zeros(0, kind)
