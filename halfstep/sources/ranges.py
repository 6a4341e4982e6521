"""Reading parts of files, and the shapes and parts of variables in them.

Files are opened by Arrow's file systems (local and mounted folders, HDFS, S3, GCS), which read byte ranges: of a classic
file only the header and the part of the variable that is asked for.
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyarrow import fs as arrow_fs

from . import cdl, classic, nc4

#: Bytes that are read for a header at first; doubled while they don't hold it.
HEADER = 16_384
#: Schemes of paths that Arrow opens.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


def scheme(path: str) -> str:
    head, found, _ = path.partition(":/")
    return head if found and "/" not in head else ""


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it."""
    kind = scheme(path)
    if kind in ("", "file"):
        return arrow_fs.LocalFileSystem(), os.path.abspath("/" + path.partition(":")[2].lstrip("/") if kind else path)
    return arrow_fs.FileSystem.from_uri("s3" + path[3:] if kind == "s3a" else path)


class File:
    """A file of one of the three forms. read counts the bytes that were read."""

    def __init__(self, path: str):
        self.path, self.read = path, 0
        fs, at = opened(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        head = self.bytes(0, 4)
        self.form = "classic" if head[:3] == b"CDF" else "nc4" if head == b"\x89HDF" else "cdl"
        self.header: classic.Header | None = None
        self.whole: dict[str, np.ma.MaskedArray] | None = None

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bytes(self, at: int, n: int) -> bytes:
        raw = self.file.read_at(n, at)
        self.read += len(raw)
        return raw

    def _header(self) -> classic.Header:
        if self.header is None:
            n = HEADER
            while self.header is None:
                raw = self.bytes(0, n)
                try:
                    self.header = classic.Header(raw)
                except (struct.error, ValueError, IndexError):
                    if n >= self.size or raw[:3] != b"CDF":
                        raise
                    n *= 2
        return self.header

    def _whole(self, variable: str) -> np.ma.MaskedArray:
        """A variable of a text or NetCDF-4 file, which is parsed whole, once."""
        if self.whole is None:
            self.whole = (nc4 if self.form == "nc4" else cdl).parse(self.bytes(0, self.size))
        return found(self.whole, variable)

    def shape(self, variable: str) -> tuple[int, ...]:
        if self.form == "classic":
            return self._header().variable(variable, self.size).shape
        return self._text_shape(variable) if self.form == "cdl" else self._whole(variable).shape

    def _text_shape(self, variable: str) -> tuple[int, ...]:
        n, raw = HEADER, self.bytes(0, HEADER)
        while n < self.size and not cdl.has_header(raw):
            raw += self.bytes(n, n)
            n *= 2
        declared = cdl.shape(raw, variable)
        return self._whole(variable).shape if declared is None or min(declared, default=0) < 0 else declared

    def part(self, variable: str, nth: int = 0, of: int = 1) -> tuple[int, np.ma.MaskedArray]:
        """The nth of so many parts of the grid points, all components, with the first point's place."""
        if self.form == "classic":
            v = self._header().variable(variable, self.size)
            start, end = v.shape[-1] * nth // of, v.shape[-1] * (nth + 1) // of
            return start, v.values(self.bytes, start, end)
        whole = self._whole(variable)
        start, end = whole.shape[-1] * nth // of, whole.shape[-1] * (nth + 1) // of
        return start, whole[..., start:end]


def found(variables: dict[str, np.ma.MaskedArray], variable: str) -> np.ma.MaskedArray:
    if variable not in variables:
        raise ValueError(f"the file of '{variable}' has no variable of that name, only {sorted(variables)}")
    return variables[variable]
