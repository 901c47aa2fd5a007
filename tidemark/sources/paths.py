"""Files by path or address, on any store that Arrow knows, so that tasks need no folder of their own."""

from __future__ import annotations

import fnmatch
import re

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local one."""
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) in order of path of the files that a file, a folder or a pattern (in the last part of a path) names; names that begin with _ or . are left out."""
    store, inner = store_of(path)
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    pattern, base = "*", inner.rstrip("/")
    if re.search(r"[*?\[]", base):
        base, pattern = base.rsplit("/", 1)
    elif store.get_file_info(base).type == fs.FileType.File:
        return [(scheme + base, store.get_file_info(base).size)]
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_." and fnmatch.fnmatch(f.base_name, pattern))


def opened(path: str):
    store, inner = store_of(path)
    return store.open_input_file(inner)
