"""Files that tasks write and read in the shared folder, through the file system its URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def new_name(directory: str, part: int, ending: str) -> str:
    """A name that no other attempt of the same task uses: only files in a committed index count."""
    return f"{directory}/part-{part:06d}-{uuid.uuid4().hex[:12]}{ending}"


def open_new(uri: str):
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_old(uri: str):
    system, path = filesystem(uri)
    return system.open_input_file(path)
