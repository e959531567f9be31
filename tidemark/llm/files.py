"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, as pyarrow knows them) and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """A new file that appears under its name only once it is whole, so a lost or repeated task leaves no half of one."""
    store, path = open_store(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        yield out
    store.move(temporary, path)


def open_file(uri: str):
    store, path = open_store(uri)
    return store.open_input_file(path)
