"""Small files in shared storage, from the driver or an executor, by URI (file, hdfs, s3, gs, ...)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def make_dir(uri: str) -> None:
    files, path = _at(uri)
    files.create_dir(path, recursive=True)


class AtomicFile:
    """A file that appears under its name only when closed without an error.

    Two attempts at one task write to names of their own, and the later rename wins with equal bytes.
    """

    def __init__(self, uri: str):
        self.files, self.path = _at(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.out = self.files.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.files.move(self.temp, self.path)
        else:
            self.files.delete_file(self.temp)


def open_input(uri: str):
    files, path = _at(uri)
    return files.open_input_file(path)
