"""Files in shared folders, from driver or executor, by URI (pyarrow file systems)."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:`` and bare paths are local mounts."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def list_files(uri: str, suffix: str) -> list[str]:
    """URIs of the committed files below a folder (or the file itself), in name order.

    Names or folders that start with ``_`` or ``.`` are not yet committed.
    """
    store, path = open_fs(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    base = path.rstrip("/")
    found = []
    for f in store.get_file_info(fs.FileSelector(base, recursive=True)):
        rest = f.path[len(base):].strip("/")
        if f.type == fs.FileType.File and f.path.endswith(suffix) and not any(
                p.startswith(("_", ".")) for p in rest.split("/")):
            found.append(f"{uri.rstrip('/')}/{rest}")
    return sorted(found)
