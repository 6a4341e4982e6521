"""CDL files read by Spark's text source: any store that Spark reads, and a task has a block of a file, not a file.

A block is what the text source gives one task of a file. What its lines mean hangs on the blocks before it, so blocks are
first taken for themselves (parsed()): values of the assignment that goes on from before (lead), and those of the variable's
own assignment where that begins in the block. A row for each block tells how many there are and what is open at its end;
of these rows the driver makes each block's first place. Files that don't go by that plan (no text, a header over 1 MB
or over more than one block, strings among the data, anything that is an error) are left to the reader of whole files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut
from . import cdl
from .names import SCHEMA

#: Values in a row of a block, and bytes of lines that are parsed at once.
VALUES, BYTES = 8_192, 1 << 20
HEADER = 1 << 20
PARSED = "variable string, timestep int, block long, lead boolean, first long, values array<double>, told string"
LEAD, OWN, OTHER, NONE = "lead", "own", "other", "none"
BEGINS = re.compile(r"\s*([\w.\-]+)\s*=(.*)", re.S)


class Odd(Exception):
    """The file isn't read by blocks."""


def numbers(items: list[str]) -> pa.Array:
    text = pa.array(items, pa.string())
    text = pc.if_else(pc.equal(text, "_"), pa.scalar(None, pa.string()), text)
    try:
        return pc.cast(text, pa.float64())
    except pa.ArrowInvalid:  # letters that tell types
        try:
            return pa.array([None if v is None else cdl.number(v) for v in text.to_pylist()], pa.float64())
        except ValueError as e:
            raise Odd from e


class Block:
    """What the lines of a block say, read in order."""

    def __init__(self, variable: str, block: int):
        self.variable = variable
        self.head: bytes | None = b"" if block == 0 else None
        self.now, self.carry, self.declared = NONE if block == 0 else LEAD, "", None
        self.n, self.begun, self.fresh, self.odd = {LEAD: 0, OWN: 0}, 0, False, False

    def feed(self, lines: list[bytes]) -> Iterator[tuple[bool, int, pa.Array]]:
        """(whether of the lead, place of the first, values) of the lines; nothing more once the block is odd."""
        if self.odd:
            return
        try:
            if self.head is not None:
                lines = self._header(lines)
            yield from self._data(b"\n".join(lines).decode("utf-8", "replace"))
        except Odd:
            self.odd = True

    def _header(self, lines: list[bytes]) -> list[bytes]:
        for k, line in enumerate(lines):
            self.head += line + b"\n"
            if len(self.head) > HEADER or self.head[:3] == b"CDF" or self.head[:4] == b"\x89HDF":
                raise Odd
            if b":" in line and (b"data" in line or line.lstrip().startswith(b":")) and cdl.has_header(self.head):
                text = cdl.plain(self.head)
                if text.count('"') % 2:  # the last line begins in a string
                    continue
                try:
                    self.declared = cdl.declared(text, self.variable)
                except (ValueError, KeyError) as e:
                    raise Odd from e
                self.head = None
                return [re.split(r"\bdata\s*:", text, maxsplit=1)[1].encode(), *lines[k + 1 :]]
        return []

    def _data(self, text: str) -> Iterator[tuple[bool, int, pa.Array]]:
        if '"' in text:
            raise Odd
        if "//" in text:
            text = "\n".join(line.partition("//")[0] for line in text.split("\n"))
        text, self.carry = self.carry + text, ""
        parts = text.split(";")
        for k, part in enumerate(parts):
            if k:
                self.now = NONE
            if self.now == LEAD and "=" in part:  # an assignment ended where the block before did
                if self.n[LEAD]:
                    raise Odd
                self.now, self.fresh = NONE, True
            if self.now == NONE:
                m = BEGINS.fullmatch(part)
                if m:
                    self.now, part = OWN if m[1] == self.variable else OTHER, m[2]
                    self.begun += self.now == OWN
                elif part.strip() in ("", "}"):
                    continue
                elif k == len(parts) - 1 and len(part) < HEADER:  # a name whose sign comes in a later line
                    self.carry = part + "\n"
                    continue
                else:
                    raise Odd
            if self.now == LEAD and part.strip() == "}" and not self.n[LEAD]:
                self.now, self.fresh = NONE, True
            if "=" in part or ("}" in part and self.now != NONE):
                raise Odd
            if self.now in self.n:
                items = part.replace(",", " ").split()
                for i in range(0, len(items), VALUES):
                    yield self.now == LEAD, self.n[self.now] + i, numbers(items[i : i + VALUES])
                self.n[self.now] += len(items)

    def told(self) -> str:
        odd = self.odd or self.head is not None or bool(self.carry.strip())
        return json.dumps({"odd": odd, "lead": self.n[LEAD], "own": self.n[OWN], "begun": self.begun, "fresh": self.fresh, "open": None if self.now == LEAD else self.now == OWN, "declared": self.declared})


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARSED from lines (variable, timestep, block, line) in order: values, and at each block's end what it told."""
    now, state = None, None

    def row(lead, first, values, told) -> pa.RecordBatch:
        variable, timestep, block = now
        columns = [pa.array([variable]), pa.array([timestep], pa.int32()), pa.array([block], pa.int64()), pa.array([lead], pa.bool_()), pa.array([first], pa.int64())]
        lists = pa.array([None], pa.list_(pa.float64())) if values is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array([told], pa.string())], ["variable", "timestep", "block", "lead", "first", "values", "told"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        lines = batch.column(3)
        edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if keys[a] != now:
                if state is not None:
                    yield row(None, None, None, state.told())
                now, state = keys[a], Block(keys[a][0], keys[a][2])
            some, size = [], 0
            for k in range(a, b):
                some.append(lines[k].as_py())
                size += len(some[-1])
                if size >= BYTES or k == b - 1:
                    for lead, first, values in state.feed(some):
                        yield row(lead, first, values, None)
                    some, size = [], 0
    if state is not None:
        yield row(None, None, None, state.told())


@dataclass
class Place:
    """Where a block's values begin in its file: those of its lead (None: another variable's) and its own."""

    lead: int | None
    own: int
    shape: tuple[int, ...]
    kind: str
    used: dict[str, float]


def placed(told: list[tuple[int, dict]], rank: int) -> dict[int, Place] | None:
    """Of a file's blocks; None where the file isn't read by blocks."""
    told = sorted(told, key=lambda b: b[0])
    if not told or told[0][0] != 0 or any(t["odd"] for _, t in told) or not told[0][1]["declared"]:
        return None
    kind, shape, used = told[0][1]["declared"]
    out, at, opened = {}, 0, False
    for block, t in told:
        if opened and t["fresh"]:
            return None
        lead = at if opened else None
        at += t["lead"] if opened else 0
        out[block] = Place(lead, at, (), kind, used)
        at += t["own"]
        opened = opened if t["open"] is None else t["open"]
    known = int(np.prod([n for n in shape if n >= 0], dtype=np.int64))
    if -1 in shape and known:  # a length that only the data tell
        shape = [at // known if n < 0 else n for n in shape]
    if len(shape) != rank or sum(t["begun"] for _, t in told) != 1 or opened or int(np.prod(shape, dtype=np.int64)) != at or min(shape) < 0:
        return None
    for p in out.values():
        p.shape = tuple(shape)
    return out


def rows_of(places: dict[tuple[str, int, int], Place]):
    """Rows of SCHEMA from those of parsed()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for variable, timestep, block, lead, first, k in zip(*(batch.column(k).to_pylist() for k in range(5)), range(batch.num_rows), strict=True):
                p = places.get((variable, timestep, block))
                if p is None or (lead and p.lead is None):
                    continue
                given = batch.column(5)[k].values
                v = cdl.unpacked(given.fill_null(0).to_numpy(zero_copy_only=False), given.is_null().to_numpy(zero_copy_only=False), p.kind, p.used)
                at = np.arange(len(v), dtype=np.int64) + first + (p.lead if lead else p.own)
                y = pa.array((at // p.shape[-1]).astype(np.int32)) if len(p.shape) == 2 else pa.nulls(len(v), pa.int32())
                values = pa.array(np.ma.getdata(v).astype(np.float32), mask=np.ma.getmaskarray(v))
                columns = [pa.array([variable] * len(v), pa.string()), pa.array(np.full(len(v), timestep, np.int32)), pa.array((at % p.shape[-1]).astype(np.int32)), y, values]
                yield pa.RecordBatch.from_arrays(columns, ["variable", "timestep", "x", "y", "value"])

    return rows


def read(spark: SparkSession, files: list[str], ranks: dict[str, int]) -> tuple[DataFrame, set[tuple[str, int]]]:
    """Rows of the files that are read by blocks, and which (variable, timestep) these are. The values are kept in the shared
    folder; a row for each block comes to the driver."""
    name = F.col("_metadata.file_name")
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.regexp_extract(name, r"^(.*)_\d+\.\w+$", 1).alias("variable"), F.regexp_extract(name, r"_(\d+)\.\w+$", 1).cast("int").alias("timestep"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    parsed = cut(lines.mapInArrow(blocks, PARSED))
    told: dict[tuple[str, int], list[tuple[int, dict]]] = {}
    for r in parsed.filter("told is not null").select("variable", "timestep", "block", "told").collect():
        told.setdefault((r["variable"], r["timestep"]), []).append((r["block"], json.loads(r["told"])))
    places = {k: placed(t, ranks[k[0]]) for k, t in told.items() if k[0] in ranks}
    plain = {k for k, p in places.items() if p is not None}
    of = {(*k, block): p for k in plain for block, p in places[k].items()}
    return parsed.filter("told is null").select("variable", "timestep", "block", "lead", "first", "values").mapInArrow(rows_of(of), SCHEMA), plain
