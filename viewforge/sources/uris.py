"""Files by URI inside tasks, where only Python runs."""

from __future__ import annotations

from pyarrow import fs


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is a mounted folder, and ``s3a`` and ``s3n`` are what others call ``s3``."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3{colon}{rest}" if scheme in ("s3a", "s3n") else uri)
