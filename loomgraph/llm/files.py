"""Files in the shared folder, by URI, from any executor (local mounts and what pyarrow.fs reaches)."""

from __future__ import annotations

import os

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A stream to a new file; its folder is made."""
    at, path = locate(uri)
    at.create_dir(os.path.dirname(path), recursive=True)
    return at.open_output_stream(path, compression=None)


def open_file(uri: str):
    at, path = locate(uri)
    return at.open_input_file(path)


def open_stream(uri: str):
    at, path = locate(uri)
    return at.open_input_stream(path, compression=None)


def remove(uri: str) -> None:
    at, path = locate(uri)
    at.delete_file(path)
