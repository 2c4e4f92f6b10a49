"""Files of any file system that Arrow knows (local, HDFS, object stores), for the Python data sources."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def listed(path: str, suffixes: tuple[str, ...]) -> list[fs.FileInfo]:
    """Files under path, or the file itself, whose names end in one of the suffixes, in order of path. One listing on the driver, without opening any."""
    system, root = at(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(suffixes)), key=lambda f: f.path)
