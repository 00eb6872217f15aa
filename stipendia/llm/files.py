"""Files in the shared folder, written and range-read by tasks."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class Output:
    """A file that appears under its name when it is complete.

    A task that is run twice writes the same name twice; readers only see whole files.
    """

    def __init__(self, path: str) -> None:
        self.system, self.path = opened(path)
        self.hidden = f"{posixpath.dirname(self.path)}/.{uuid.uuid4().hex}"
        self.system.create_dir(posixpath.dirname(self.path), recursive=True)
        self.stream = self.system.open_output_stream(self.hidden)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Append; returns where it begins."""
        begin = self.at
        self.stream.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.hidden, self.path)


def read_range(path: str, begin: int, size: int) -> bytes:
    system, name = opened(path)
    with system.open_input_file(name) as stream:
        return stream.read_at(size, begin)


def file_size(path: str) -> int:
    system, name = opened(path)
    return system.get_file_info(name).size
