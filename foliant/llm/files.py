"""Whole-file reads and writes by executors, in any store that pyarrow opens."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def written_whole(uri: str):
    """A binary sink whose file appears under ``uri`` only when it is complete.

    A task that is run again, or twice at once, replaces the file by equal bytes.
    """
    store, path = store_of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(part, compression=None) as sink:
            yield sink
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type == pafs.FileType.File:
            store.delete_file(part)
        raise


def opened(uri: str):
    """A random-access source: a memory map where the file is local."""
    store, path = store_of(uri)
    if isinstance(store, pafs.LocalFileSystem) and os.path.getsize(path):
        import pyarrow as pa

        return pa.memory_map(path)
    return store.open_input_file(path)
