"""Files read by ranges of bytes, in any store that Arrow's file systems open, and their listing."""

from __future__ import annotations

import fnmatch
import posixpath

import pyarrow.fs as pafs

#: Bytes read at once where few are asked for, and such pages that a file keeps.
PAGE, KEPT = 1 << 16, 64


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, as Spark writes it or plain, and the path there."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), posixpath.abspath(uri)
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def listed(uri: str, pattern: str | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a path whose names match, by path; hidden ones are left out."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(uri, info.size)]
    scheme = uri[: uri.index("://") + 3] if "://" in uri else ""
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    keep = (f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
    return sorted((scheme + f.path, f.size) for f in keep if pattern is None or fnmatch.fnmatch(f.base_name, pattern))


class Ranged:
    """A file as bytes of which slices are read when they are asked for. `read` counts the bytes that came from it."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.read = 0
        self.pages: dict[int, bytes] = {}

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __len__(self) -> int:
        return self.size

    def _get(self, at: int, n: int) -> bytes:
        self.read += n
        return self.file.read_at(n, at)

    def __getitem__(self, at: slice | int) -> bytes | int:
        if isinstance(at, int):
            return self[at : at + 1][0]
        first, last, step = at.indices(self.size)
        if step != 1:
            raise ValueError("slices of single steps only")
        if last <= first:
            return b""
        if last - first >= PAGE:
            return self._get(first, last - first)
        parts = []
        for k in range(first // PAGE, (last - 1) // PAGE + 1):
            if k not in self.pages:
                if len(self.pages) >= KEPT:
                    self.pages.clear()
                self.pages[k] = self._get(k * PAGE, min(PAGE, self.size - k * PAGE))
            parts.append(self.pages[k][max(first - k * PAGE, 0) : last - k * PAGE])
        return b"".join(parts)
