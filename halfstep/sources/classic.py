"""NetCDF classic files (CDF-1, CDF-2 and CDF-5), by the public format description: a header of dimensions, attributes
and variables, then the variables' values, big-endian; record variables are interleaved by record."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Default fill values of the format (fixed values).
FILLS = {1: -127, 3: -32767, 4: -2147483647, 5: 9.9692099683868690e36, 6: 9.9692099683868690e36, 7: 255, 8: 65535, 9: 4294967295, 10: -9223372036854775806, 11: 18446744073709551614}


class Variable:
    """A variable's shape, and its values by ranges of the last dimension."""

    def __init__(self, shape: tuple[int, ...], kind: int, attributes: dict[str, np.ndarray], begin: int, stride: int | None):
        self.shape, self.kind, self.begin, self.stride = shape, kind, begin, stride  # stride: bytes from record to record
        self.attributes, self.dtype = attributes, np.dtype(TYPES[kind])

    def values(self, read: Callable[[int, int], bytes], start: int, end: int) -> np.ma.MaskedArray:
        """Values of places start to end of the last dimension, masked at the fill value and unpacked by scale_factor and
        add_offset. Only the bytes of these places are read; those between records too where places are records."""
        size = self.dtype.itemsize
        if not self.shape:
            parts, shape = [read(self.begin, size)], ()
        elif len(self.shape) == 1 and self.stride is not None:
            raw = read(self.begin + start * self.stride, max(0, (end - start - 1) * self.stride + size)) if end > start else b""
            at = np.arange(end - start)[:, None] * self.stride + np.arange(size)
            parts, shape = [np.frombuffer(raw, np.uint8)[at].tobytes()], (end - start,)
        else:
            n, shape = self.shape[-1], (*self.shape[:-1], end - start)
            inner = int(np.prod(self.shape[(self.stride is not None) : -1], dtype=np.int64))  # lines in a record, or in all
            records = range(self.shape[0]) if self.stride is not None else range(1)
            lines = range(inner)
            if (start, end) == (0, n):  # whole lines lie side by side
                inner, n, lines, end = 1, n * inner, range(1), n * inner
            parts = [read(self.begin + r * (self.stride or 0) + (k * n + start) * size, (end - start) * size) for r in records for k in lines]
        raw = b"".join(parts)
        if len(raw) < int(np.prod(shape, dtype=np.int64)) * size:
            raise ValueError("a NetCDF classic file ends before its values do")
        values = np.frombuffer(raw, self.dtype).reshape(shape)
        fill = self.attributes["_FillValue"][0] if "_FillValue" in self.attributes else np.array(FILLS[self.kind]).astype(self.dtype) if self.kind in FILLS else None
        masked = np.ma.MaskedArray(values, False if fill is None else values == fill)
        if "scale_factor" in self.attributes or "add_offset" in self.attributes:
            masked = masked * float(self.attributes.get("scale_factor", [1])[0]) + float(self.attributes.get("add_offset", [0])[0])
        return masked


class Header:
    """The header of a file, from its first bytes; errors if they don't hold all of it."""

    def __init__(self, raw: bytes):
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.raw, self.at = raw, 4
        self.count, self.offset = (">q", ">q") if raw[3] == 5 else (">i", ">q" if raw[3] == 2 else ">i")
        self.records = self.number(self.count)
        self.dims = [(self.name(), self.number(self.count)) for _ in self.items(10)]
        self.attributes()
        self.variables = []
        for _ in self.items(11):
            name = self.name()
            dims = [self.number(self.count) for _ in range(self.number(self.count))]
            attributes = self.attributes()
            kind = self.number(">i")
            self.number(self.count)
            self.variables.append((name, dims, attributes, kind, self.number(self.offset)))

    def number(self, form: str) -> int:
        (x,) = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return x

    def name(self) -> str:
        n = self.number(self.count)
        if self.at + n > len(self.raw):
            raise struct.error("the header goes on")
        s = self.raw[self.at : self.at + n].decode("utf-8")
        self.at += -(-n // 4) * 4
        return s

    def items(self, tag: int) -> range:
        found, n = self.number(">i"), self.number(self.count)
        if found not in (0, tag):
            raise ValueError("broken NetCDF header")
        return range(n)

    def attributes(self) -> dict[str, np.ndarray]:
        out = {}
        for _ in self.items(12):
            name, kind, n = self.name(), self.number(">i"), self.number(self.count)
            size = np.dtype(TYPES[kind]).itemsize * n
            out[name] = np.frombuffer(self.raw, TYPES[kind], n, self.at)
            self.at += -(-size // 4) * 4
        return out

    def _size(self, v: tuple) -> int:
        """Bytes of a variable, or of a record of it."""
        _, dims, _, kind, _ = v
        return int(np.prod([self.dims[d][1] for d in dims if self.dims[d][1]], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize

    def _by_record(self, v: tuple) -> bool:
        return bool(v[1]) and self.dims[v[1][0]][1] == 0

    def variable(self, name: str, file_size: int) -> Variable:
        v = next((v for v in self.variables if v[0] == name and v[3] != 2), None)
        if v is None:
            raise ValueError(f"the file of '{name}' has no variable of that name, only {sorted(v[0] for v in self.variables)}")
        _, dims, attributes, kind, begin = v
        shape, stride = [self.dims[d][1] for d in dims], None
        if self._by_record(v):
            of_records = [w for w in self.variables if self._by_record(w)]
            stride = sum(self._size(w) if len(of_records) == 1 else -(-self._size(w) // 4) * 4 for w in of_records)
            # a file that was written as a stream has no record count; the bytes from the first record on tell it
            shape[0] = self.records if self.records >= 0 else (file_size - min(w[4] for w in of_records)) // max(1, stride)
        return Variable(tuple(shape), kind, attributes, begin, stride)


def parse(content: bytes) -> dict[str, np.ma.MaskedArray]:
    """The numeric variables of a classic file, whole."""
    header = Header(content)
    of = {v[0]: header.variable(v[0], len(content)) for v in header.variables if v[3] != 2}
    return {name: v.values(lambda at, n: content[at : at + n], 0, v.shape[-1] if v.shape else 1) for name, v in of.items()}


def layout(shapes: dict[str, tuple[list[str], tuple[int, ...], str]], version: int = 1) -> tuple[bytes, dict[str, int]]:
    """The header of a file with these variables, (dimension names, shape, type code), without records or attributes, and
    where the values of each begin."""
    count, offset = (">q", ">q") if version == 5 else (">i", ">q" if version == 2 else ">i")
    kinds = {"b": 1, "h": 3, "i": 4, "f": 5, "d": 6}
    sizes = {n: -(-int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[kinds[code]]).itemsize // 4) * 4 for n, (_, shape, code) in shapes.items()}
    dims: dict[str, int] = {}
    for names, shape, _ in shapes.values():
        dims |= dict(zip(names, shape, strict=True))

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(count, len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF" + bytes([version]) + struct.pack(count, 0)
        out += struct.pack(">i", 10) + struct.pack(count, len(dims)) + b"".join(text(k) + struct.pack(count, n) for k, n in dims.items())
        out += struct.pack(">i", 0) + struct.pack(count, 0) + struct.pack(">i", 11) + struct.pack(count, len(shapes))
        for name, (names, _, code) in shapes.items():
            out += text(name) + struct.pack(count, len(names)) + b"".join(struct.pack(count, list(dims).index(d)) for d in names)
            out += struct.pack(">i", 0) + struct.pack(count, 0) + struct.pack(">i", kinds[code])
            out += struct.pack(count, sizes[name] if version == 5 else min(sizes[name], 2**31 - 4)) + struct.pack(offset, begins[name])
        return out

    at, begins = len(header(dict.fromkeys(shapes, 0))), {}
    for name in shapes:
        begins[name] = at
        at += sizes[name]
    return header(begins), begins


def write(variables: dict[str, tuple[list[str], np.ndarray]], version: int = 1) -> bytes:
    """A whole file with these variables, (dimension names, values)."""
    head, _ = layout({n: (names, v.shape, "i" if v.dtype.char == "l" else v.dtype.char) for n, (names, v) in variables.items()}, version)
    bodies = [v.astype(v.dtype.newbyteorder(">")).tobytes() for _, v in variables.values()]
    return head + b"".join(b.ljust(-(-len(b) // 4) * 4, b"\0") for b in bodies)
