"""Files by byte ranges on any file system a path names: local paths, ``file:``, and what Arrow can open besides (``hdfs:``, ``s3:`` and others)."""

from __future__ import annotations

import pyarrow.fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path on it."""
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else ""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
    return pafs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    fs, p = place(path)
    return fs.get_file_info(p).size


def open_at(path: str):
    """The file, to be read from any place."""
    fs, p = place(path)
    return fs.open_input_file(p)


def files_of(path: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files of a folder with this ending, in order of their names."""
    fs, p = place(path)
    scheme = path.split("/", 1)[0] + "//" if "://" in path and not path.startswith("file:") else ""
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(p))
    return sorted((scheme + f.path if scheme else f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith(("_", ".")))


def ranges_of(path: str, split: int, ending: str = "") -> list[tuple[str, int, int]]:
    """(path, start, stop) of byte ranges of at most ``split`` bytes."""
    return [(f, a, min(a + split, n)) for f, n in files_of(path, ending) for a in range(0, n, split)]


def publish(folder: str, name: str, attempt: str, write) -> str:
    """A file of a folder, written under another name by ``write(stream)`` and moved to its place when it is whole."""
    fs, p = place(folder)
    fs.create_dir(p, recursive=True)
    partial, target = f"{p}/.{name}.{attempt}.tmp", f"{p}/{name}"
    with fs.open_output_stream(partial) as f:
        write(f)
    fs.move(partial, target)
    return f"{folder.rstrip('/')}/{name}"


def remove(path: str) -> None:
    fs, p = place(path)
    if fs.get_file_info(p).type == pafs.FileType.File:
        fs.delete_file(p)
