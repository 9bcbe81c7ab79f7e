"""Numpy arrays in a folder that all executors share, memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import sys
import tempfile
import uuid

import numpy as np
from pyarrow import fs

# Python up to 3.12 keeps a file open as long as it is mapped.
_NOT_KEPT = {"trackfd": False} if sys.version_info >= (3, 13) else {}


class SharedArrays:
    """Arrays by name. A file appears whole or not at all, so a task that runs again may write it again."""

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, name: str, array: np.ndarray) -> None:
        store, root = self._at()
        store.create_dir(root, recursive=True)
        part = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
        store.move(part, f"{root}/{name}")

    def names(self) -> set[str]:
        """Of the arrays that are there."""
        store, root = self._at()
        files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {f.base_name for f in files if f.is_file and not f.base_name.startswith(".")}

    def read(self, name: str, dtype) -> np.ndarray:
        """Mapped where the folder is mounted; else a copy is mapped that goes with the process."""
        store, root = self._at()
        if isinstance(store, fs.LocalFileSystem):
            with open(f"{root}/{name}", "rb") as file:
                return _mapped(file, dtype)
        with tempfile.NamedTemporaryFile() as copy:
            with store.open_input_stream(f"{root}/{name}") as source:
                while block := source.read(1 << 24):
                    copy.write(block)
            copy.flush()
            return _mapped(copy, dtype)


def _mapped(file, dtype) -> np.ndarray:
    """The array of an open file, which needs not stay open: a worker may hold more arrays than files."""
    if not os.fstat(file.fileno()).st_size:
        return np.zeros(0, dtype)
    return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **_NOT_KEPT), dtype)
