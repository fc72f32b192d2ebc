"""Files in the shared folder, written and read by executors through pyarrow's filesystems."""

from __future__ import annotations

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
