"""The text form of NetCDF files (CDL), as far as gridded variables need it: dimensions, numeric variables, data,
attributes (`_FillValue`, `scale_factor` and `add_offset` are used, others passed over) and comments."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TYPES = {"byte": "i1", "ubyte": "u1", "short": "i2", "ushort": "u2", "int": "i4", "long": "i4", "uint": "u4", "int64": "i8", "uint64": "u8", "float": "f4", "real": "f4", "double": "f8"}
#: A string, or a comment to the line's end, whichever begins first.
ASIDE = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*', re.S)
#: A number with the letters that tell its type.
NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))[a-zA-Z]*")
#: Characters of a value in files that are written, with the two that part it from the next; values in a line; what ends a file.
CELL, LINE, END = 18, 16, b"\n}\n"
ODD = re.compile(r"([+-]?(?:nan|inf(?:inity)?))[fd]?", re.I)


def plain(content: bytes) -> str:
    """Text without comments, strings emptied."""
    return ASIDE.sub(lambda m: '""' if m[0][0] == '"' else "", content.decode("utf-8", "replace"))


def number(item: str) -> float:
    m = ODD.fullmatch(item) or NUMBER.fullmatch(item)
    if not m:
        raise ValueError(f"'{item}' is not a number in a CDL file")
    return float(m[1])


def _section(text: str, name: str, after: str) -> str:
    m = re.search(rf"\b{name}\s*:(.*?)(?=\b(?:{after})\s*:|\}}\s*$|\Z)", text, re.S)
    return m[1] if m else ""


def _declared(text: str) -> dict[str, tuple[str, list[int]]]:
    """Type and shape of each variable, -1 for a length that only the data tell."""
    if not re.match(r"\s*netcdf\b", text):
        raise ValueError("not a CDL file")
    sizes = dict(re.findall(r"([\w.\-]+)\s*=\s*(\d+|UNLIMITED)", _section(text, "dimensions", "variables|data")))
    found = re.findall(rf"\b({'|'.join(TYPES)})\s+([\w.\-]+)\s*(?:\(([^)]*)\))?\s*;", _section(text, "variables", "data"))
    return {name: (kind, [-1 if sizes[d] == "UNLIMITED" else int(sizes[d]) for d in re.split(r"[\s,]+", dims.strip()) if d]) for kind, name, dims in found}


def has_header(content: bytes) -> bool:
    """Whether these first bytes of a file hold all its declarations."""
    return bool(re.search(r"\bdata\s*:", plain(content)))


def shape(content: bytes, variable: str) -> tuple[int, ...] | None:
    """The declared shape of a variable, None if it isn't declared."""
    declared = _declared(plain(content)).get(variable)
    return tuple(declared[1]) if declared else None


def _used(text: str) -> dict[tuple[str, str], float]:
    """The attributes that values depend on, by variable and name."""
    used = re.findall(r"([\w.\-]+):(_FillValue|scale_factor|add_offset)\s*=\s*([^;\s,]+)", _section(text, "variables", "data"))
    return {(name, what): number(value) for name, what, value in used}


def declared(text: str, variable: str) -> tuple[str, list[int], dict[str, float]]:
    """Type, shape (-1 for a length that only the data tell) and attributes of a variable, from a file's text without
    comments, up to its data."""
    return *_declared(text)[variable], {what: v for (name, what), v in _used(text).items() if name == variable}


def unpacked(values: np.ndarray, hidden: np.ndarray, kind: str, used: dict[str, float]) -> np.ma.MaskedArray:
    """Numbers as the variable's type, masked at `_` and the fill value and unpacked by scale_factor and add_offset."""
    values = values.astype(TYPES[kind])
    if "_FillValue" in used:
        hidden = hidden | (values == np.array(used["_FillValue"]).astype(TYPES[kind]))
    v = np.ma.MaskedArray(values, hidden)
    if {"scale_factor", "add_offset"} & used.keys():
        v = v * used.get("scale_factor", 1.0) + used.get("add_offset", 0.0)
    return v


def parse(content: bytes) -> dict[str, np.ma.MaskedArray]:
    """The variables of a CDL file, masked where they have the fill value or `_`, unpacked by scale_factor and add_offset."""
    text = plain(content)
    data = dict(re.findall(r"([\w.\-]+)\s*=\s*([^;]*);", _section(text, "data", "$^")))
    used, out = _used(text), {}
    for name, (kind, size) in _declared(text).items():
        if name not in data:
            continue
        items = [v for v in re.split(r"[\s,]+", data[name].strip()) if v]
        hidden = np.array([v == "_" for v in items], bool)
        values = np.array([0 if v == "_" else number(v) for v in items])
        out[name] = unpacked(values, hidden, kind, {what: v for (of, what), v in used.items() if of == name}).reshape(size)
    return out


def head(name: str, variable: str, shape: tuple[int, ...]) -> bytes:
    """A file of one variable of floats, up to its values."""
    dims = ["y", "x"][-len(shape) :]
    sizes = "".join(f"\t{d} = {n} ;\n" for d, n in zip(dims, shape, strict=True))
    return f"netcdf {name} {{\ndimensions:\n{sizes}variables:\n\tfloat {variable}({', '.join(dims)}) ;\ndata:\n\n {variable} =\n".encode()


def cells(values: pa.Array, places: np.ndarray, last: int) -> np.ndarray:
    """Floats as text, a row of CELL characters for the value of each place, null as `_`."""
    text = pc.utf8_lpad(pc.cast(values, pa.string()).fill_null("_"), CELL - 2)
    raw = b"".join(text.cast(pa.binary()).to_pylist())
    if len(raw) != len(text) * (CELL - 2):
        raise ValueError(f"a value takes more than {CELL - 2} characters")
    out = np.empty((len(text), CELL), np.uint8)
    out[:, :-2] = np.frombuffer(raw, np.uint8).reshape(len(text), CELL - 2)
    out[:, -2] = np.where(places == last, ord(" "), ord(","))
    out[:, -1] = np.where(places == last, ord(";"), np.where((places + 1) % LINE == 0, ord("\n"), ord(" ")))
    return out
