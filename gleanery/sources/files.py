"""Direct listing of input directories, on any file system Arrow can reach.

Spark's own file sources skip empty files and names that start with ``_``, and
both count here.
"""

from __future__ import annotations

import os

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def spark_path(path: str) -> str:
    """``path`` as Spark must be given it to mean the same place."""
    return path if ":" in path.split("/")[0] else f"file:{os.path.abspath(path)}"


def list_files(directory: str, suffix: str) -> list[tuple[str, int]]:
    """Path and size of the files directly in ``directory``, sorted by path.

    Hidden files do not count.  Raises if the directory is missing.
    """
    filesystem, inner = resolve(directory)
    infos = filesystem.get_file_info(fs.FileSelector(inner))
    return sorted(
        (f"{directory.rstrip('/')}/{info.base_name}", info.size) for info in infos
        if info.is_file and info.base_name.endswith(suffix) and info.base_name[0] != ".")


def states(files: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and time of change (ns, 0 if unknown) of some files."""
    found = []
    for path in files:
        filesystem, inner = resolve(path)
        info = filesystem.get_file_info(inner)
        found.append((path, info.size, info.mtime_ns or 0))
    return found


def read_lines(directory: str) -> list[str]:
    """The lines of all ``part-*`` files of a directory; none if it is missing."""
    filesystem, inner = resolve(directory)
    lines = []
    for info in filesystem.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if info.base_name.startswith("part-"):
            with filesystem.open_input_stream(info.path) as stream:
                lines += stream.read().decode("utf-8").splitlines()
    return lines


def list_archives(path: str) -> list[tuple[str, int]]:
    """The ``*.gz`` archives of a directory, or the one archive ``path`` names."""
    filesystem, inner = resolve(path)
    info = filesystem.get_file_info(inner)
    if info.is_file:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"archive directory does not exist: {path}")
    found = list_files(path, ".gz")
    if not found:
        raise ValueError(f"no .gz archives in {path}")
    return found
