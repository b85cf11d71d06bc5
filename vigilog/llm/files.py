"""Whole files in the shared folder, written and read inside tasks through Arrow's file systems."""

from __future__ import annotations


def _place(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system, inner


def write_bytes(path: str, data: bytes) -> None:
    system, inner = _place(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    system, inner = _place(path)
    with system.open_input_stream(inner, compression=None) as source:
        return source.read()


def read_range(path: str, start: int, size: int) -> bytes:
    system, inner = _place(path)
    with system.open_input_file(inner) as source:
        return source.read_at(size, start)
