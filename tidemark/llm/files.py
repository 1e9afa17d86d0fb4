"""Files that tasks write and read in the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path on it."""
    if folder.startswith("file:/"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it: a task that runs again leaves one whole file."""
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        system.delete_file(f"{path}/{name}")
    system.move(part, f"{path}/{name}")
