"""Progressive JPEG media columns.

Encoding: payload bytes, less 128, are the quantised coefficients of a progressive JPEG file in zigzag order (quantisers
are 1, chroma is subsampled 2 x 2, six blocks of 64 to an MCU), so the file holds them without loss. Seven scans send
them: first bits of DC, luma's low band with one bit less, chroma, luma's high band, then the bits left out.

Decoding: the scans of a file are accumulated into coefficient arrays: spectral selection and successive approximation,
DC and AC, first and refining passes, restart intervals. These are dequantised and inverse-transformed in integers,
chroma is upsampled and the full-resolution RGB tensor made. All of this is numpy: restart segments of many files are
decoded in step, each a lane. Any progressive Huffman file with 8-bit samples and one or three components can be decoded. A
file without its end, with a restart segment too few or too many, or out of order, is an error, and a payload is only
given if the scans have sent all bits of all coefficients.

Null texts count as empty and are padded to one unit of 192 bytes. Equal payloads give equal files and tensors, so repeated
rows do. Empty tables give empty results; columns other than key and text may have any names. A very long text is one
file, which one task holds with its coefficients; scans and samples are made in lots.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table
from .langid import chunks

UNIT, RESTART, MOST_HIGH, CHUNK, ORDERS = 192, 16, 4_095, 2_000_000, 32 << 20
#: Restart segments that are coded at once, and blocks of a file from which its tensor is made band by band.
LOT, BAND = 2_048, 16_384
#: (components, Ss, Se, Ah, Al) of the scans that are written.
SCANS = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 5, 1, 0)]
FACTORS = [(2, 2), (1, 1), (1, 1)]


def zigzag() -> np.ndarray:
    """Place in the block, by rows, of each coefficient in zigzag order."""
    at = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in at])


ZIGZAG = zigzag()
#: Huffman tables by rule: DC sizes take 4 bits; so do AC sizes without a run, other AC symbols take 10.
DC_TABLE = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
AC_TABLE = ([0, 0, 0, 11, 0, 0, 0, 0, 0, 165] + [0] * 6, [*range(11), *(r << 4 | s for r in range(1, 16) for s in range(11))])
SIZE = np.array([k.bit_length() for k in range(1 << 12)], np.uint8)


def codes_of(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and its length for each symbol."""
    code, k = 0, 0
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.uint8)
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            codes[s], lengths[s] = code, bits
            code += 1
        k += n
        code <<= 1
    return codes, lengths


# ---- encoding


def pack(value: np.ndarray, bits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes values of so many bits (under 33) one after another; those from each index of first on begin at a byte, the
    gap before being filled with ones. Gives the bytes and where in them each run begins, with the end."""
    cum = np.cumsum(bits, dtype=np.int64)
    length = np.diff(np.concatenate([(cum - bits)[first], cum[-1:]]))
    size = (length + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(size)])
    at = cum - bits + np.repeat(8 * begin[:-1] - (cum - bits)[first], np.diff(np.concatenate([first, [len(bits)]])))
    word = at >> 6
    shift = 64 - (at & 63) - bits
    over = np.flatnonzero(shift < 0)
    high = value << np.maximum(shift, 0).astype(np.uint64)
    high[over] = value[over] >> (-shift[over]).astype(np.uint64)
    out = np.zeros(int(begin[-1] >> 3) + 2, np.uint64)
    new = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    out[word[new]] = np.add.reduceat(high, new)
    out[word[over] + 1] += value[over] << (64 + shift[over]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)[: begin[-1]].copy()
    data[begin[1:] - 1] |= ((1 << (8 * size - length)) - 1).astype(np.uint8)
    return data, begin


def ac_items(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pass over AC coefficients v (blocks by band): values, bits, and the index of each block's first item."""
    codes, lengths = codes_of(*AC_TABLE)
    blocks, band = v.shape
    a = (np.abs(v) >> low).ravel()
    at = np.flatnonzero(a)
    a = a[at].astype(np.int64)
    block = at // band
    run = np.diff(at, prepend=-1) - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = block[1:] != block[:-1]
    run[fresh] = at[fresh] - block[fresh] * band
    size = SIZE[a].astype(np.int64)
    extra = np.where(v.ravel()[at] < 0, (1 << size) - 1 - a, a)
    symbol = (run & 15) << 4 | size
    value, bits = (codes[symbol] << size.astype(np.uint64)) | extra.astype(np.uint64), lengths[symbol].astype(np.int64) + size
    last = np.full(blocks, -1)
    last[block] = at - block * band
    ends = np.flatnonzero(last < band - 1)  # blocks with an end-of-block code
    zeros = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)  # items with 16-zero codes before them
    if len(ends) or len(zeros):
        place = np.concatenate([np.searchsorted(block, ends, side="right"), zeros])  # at one place, the end comes first
        symbols = np.concatenate([np.zeros(len(ends), np.int64), np.full(len(zeros), 0xF0)])
        value, bits = np.insert(value, place, codes[symbols]), np.insert(bits, place, lengths[symbols].astype(np.int64))
        block = np.insert(block, place, np.concatenate([ends, block[zeros]]))
    return value, bits, np.searchsorted(block, np.arange(blocks))


def ac_refine_items(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refining pass over a band of at most 5 coefficients: one item for each block, as two halves of up to 32 bits."""
    codes, lengths = (x.astype(np.uint64) for x in codes_of(*AC_TABLE))
    n = len(v)
    acc, used, wait, waiting, run = (np.zeros(n, np.uint64) for _ in range(5))
    one = np.uint64(1)
    for k in range(v.shape[1]):
        a = (np.abs(v[:, k]) >> low).astype(np.uint64)
        old, new = a > 1, a == 1
        wait[old] = wait[old] << one | (a[old] & one)
        waiting[old] += one
        symbol = (run << np.uint64(4) | one).astype(np.int64)
        for m, c, b in ((new, codes[symbol], lengths[symbol]), (new, (v[:, k] >= 0).astype(np.uint64), np.ones(n, np.uint64)), (new, wait, waiting)):
            acc[m] = acc[m] << b[m] | c[m]
            used[m] += b[m]
        wait[new], waiting[new], run[new] = 0, 0, 0
        run[a == 0] += one
    m = (run > 0) | (waiting > 0)
    acc[m] = (acc[m] << lengths[0] | codes[0]) << waiting[m] | wait[m]
    used[m] += lengths[0] + waiting[m]
    right = np.minimum(used, np.uint64(32))
    halves = np.stack([acc >> right, acc & ((one << right) - one)], 1).ravel()
    return halves, np.stack([used - right, right], 1).astype(np.int64).ravel(), 2 * np.arange(n)


class Shape:
    """How a file's blocks lie: MCUs by rows, and for each component the width of its padded plane in blocks."""

    def __init__(self, width: int, height: int, factors: list[tuple[int, int]]):
        self.width, self.height, self.factors = width, height, factors
        self.h, self.v = max(f[0] for f in factors), max(f[1] for f in factors)
        self.mx, self.my = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        self.wide = [self.mx * h for h, _ in factors]
        self.blocks = [self.mx * self.my * h * v for h, v in factors]
        self.key = (width, height, tuple(factors))

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """Component and block of each block of a scan, and the blocks of its MCU."""
        if len(components) > 1:
            at = np.arange(self.mx * self.my)
            parts = [(c, (at // self.mx * v + y) * self.wide[c] + at % self.mx * h + x) for c in components for h, v in [self.factors[c]] for y in range(v) for x in range(h)]
            return np.tile([c for c, _ in parts], len(at)), np.stack([b for _, b in parts], 1).ravel(), len(parts)
        (c,) = components
        h, v = self.factors[c]
        wide, high = -(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)
        at = np.arange(wide * high)
        return np.full(len(at), c), at // wide * self.wide[c] + at % wide, 1


_orders: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}
_kept = [0]  # bytes of the orders that are kept


def order_of(shape: Shape, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    key = (*shape.key, components)
    if key not in _orders:
        out = shape.order(components)
        size = out[0].nbytes + out[1].nbytes
        if size > ORDERS // 4:
            return out
        if _kept[0] + size > ORDERS:
            _orders.clear()
            _kept[0] = 0
        _orders[key] = out
        _kept[0] += size
    return _orders[key]


def shape_for(payload: int) -> Shape:
    mcus = -(-payload // 384)
    wide = -(-mcus // MOST_HIGH)
    return Shape(16 * wide, 16 * -(-mcus // wide), FACTORS)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLES = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"".join(bytes([c << 4, *counts, *symbols]) for c, (counts, symbols) in enumerate((DC_TABLE, AC_TABLE)))) + segment(0xDD, struct.pack(">H", RESTART))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload; the payload's length is in a comment."""
    shapes = [shape_for(len(p)) for p in payloads]
    blocks = [[], [], []]
    for p, s in zip(payloads, shapes, strict=True):
        given = np.full(s.mx * s.my * 384, 128, np.uint8)
        given[: len(p)] = np.frombuffer(p, np.uint8)
        c, b, n = order_of(s, (0, 1, 2))
        mcus = given.reshape(-1, n, 64)
        plane = np.empty((s.blocks[0], 64), np.uint8)
        plane[b.reshape(-1, n)[:, :4]] = mcus[:, :4]
        for k, x in enumerate((plane, mcus[:, 4], mcus[:, 5])):
            blocks[k].append(x)
    planes = [np.concatenate(x).astype(np.int16) - 128 for x in blocks]
    starts = [np.concatenate([[0], np.cumsum([s.blocks[c] for s in shapes])]) for c in range(3)]
    bodies: list[list[bytes]] = [[] for _ in payloads]
    for components, ss, se, ah, al in SCANS:
        mcu_blocks = 6 if len(components) > 1 else 1
        counts = np.array([s.blocks[0] * 6 // 4 if len(components) > 1 else s.blocks[components[0]] for s in shapes])
        segments = -(-counts // (mcu_blocks * RESTART))
        owner = np.repeat(np.arange(len(shapes)), segments)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        first_block = (np.cumsum(counts) - counts)[owner] + nth * mcu_blocks * RESTART
        head = segment(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), ss, se, ah << 4 | al]))
        goes_on = nth < segments[owner] - 1
        upto = np.append(first_block, counts.sum())
        values = np.concatenate([_dc_in_order(planes, starts, s, k) for k, s in enumerate(shapes)]) >> al if se == 0 else None
        for a in range(0, len(owner), LOT):  # segments of a lot
            some = slice(a, a + LOT)
            lo, hi = int(upto[a]), int(upto[min(a + LOT, len(owner))])
            first = first_block[some] - lo
            if values is not None:
                value, bits = dc_items(values[lo:hi], first, bool(ah))
            else:
                value, bits, items = (ac_refine_items if ah else ac_items)(planes[components[0]][lo:hi, ss : se + 1], al)
                first = items[first]
            data, begin = pack(value, bits, first)
            stuffed = np.flatnonzero(data == 255) + 1
            more = goes_on[some]
            restarts = begin[1:][more]
            place = np.concatenate([stuffed, np.repeat(restarts, 2)])
            marks = np.stack([np.full(len(restarts), 255), 0xD0 + nth[some][more] % 8], 1).ravel()
            raw = np.insert(data, place, np.concatenate([np.zeros(len(stuffed), np.int64), marks]).astype(np.uint8)).tobytes()
            of = owner[some]
            last = np.flatnonzero(np.append(of[1:] != of[:-1], True))  # of each file in the lot
            ends = begin[1:][last]
            ends = ends + np.searchsorted(stuffed, ends, side="right") + 2 * np.searchsorted(restarts, ends, side="right")
            at = 0
            for k, end in zip(of[last].tolist(), ends.tolist(), strict=True):
                if at or nth[a] == 0:
                    bodies[k].append(head)
                bodies[k].append(raw[at:end])
                at = end
    out = []
    for p, s, body in zip(payloads, shapes, bodies, strict=True):
        frame = segment(0xC2, struct.pack(">BHHB", 8, s.height, s.width, 3) + bytes(x for c, (h, v) in enumerate(FACTORS) for x in (c + 1, h << 4 | v, 0)))
        out.append(b"\xff\xd8" + segment(0xFE, b"payload %d" % len(p)) + TABLES + frame + b"".join(body) + b"\xff\xd9")
    return out


def dc_items(values: np.ndarray, fresh: np.ndarray, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values and bits for DC coefficients of whole MCUs in order; prediction begins anew at the MCUs that start at the
    blocks in fresh."""
    if refine:
        return (values & 1).astype(np.uint64), np.ones(len(values), np.int64)
    by_mcu = values.reshape(-1, 6)
    back = np.zeros_like(by_mcu)
    back[:, 1:4] = by_mcu[:, :3]
    back[1:, 0], back[1:, 4:] = by_mcu[:-1, 3], by_mcu[:-1, 4:]
    back[fresh // 6, 0], back[fresh // 6, 4:] = 0, 0
    d = (values - back.ravel()).astype(np.int64)
    codes, lengths = codes_of(*DC_TABLE)
    size = SIZE[np.abs(d)].astype(np.int64)
    extra = np.where(d < 0, d + (1 << size) - 1, d)
    return codes[size] << size.astype(np.uint64) | extra.astype(np.uint64), lengths[size].astype(np.int64) + size


def _dc_in_order(planes: list[np.ndarray], starts: list[np.ndarray], s: Shape, k: int) -> np.ndarray:
    c, b, n = order_of(s, (0, 1, 2))
    out = np.empty((s.mx * s.my, 6), np.int32)
    by = b.reshape(-1, 6)
    out[:, :4] = planes[0][starts[0][k] + by[:, :4], 0]
    for x in (1, 2):
        out[:, 3 + x] = planes[x][starts[x][k] + by[:, 3 + x], 0]
    return out.ravel()


# ---- decoding


class Huffman:
    """For every 16 bits to come: bits used, coefficients passed over, and value, in one number; -1 where more must be
    looked at. AC tables and DC tables differ in what a symbol means."""

    def __init__(self, counts: list[int], symbols: list[int], ac: bool):
        codes, lengths = codes_of(counts, symbols)
        self.symbol, self.length = np.zeros(65536, np.int32), np.zeros(65536, np.int32)
        for s in symbols:
            n = int(lengths[s])
            a = int(codes[s]) << (16 - n)
            self.symbol[a : a + (1 << (16 - n))], self.length[a : a + (1 << (16 - n))] = s, n
        run, size = (self.symbol >> 4, self.symbol & 15) if ac else (np.zeros(65536, np.int32), self.symbol)
        total = self.length + size
        peek = np.arange(65536)
        extra = (peek >> np.maximum(16 - total, 0)) & ((1 << size) - 1)
        value = extended(extra, size)
        run = np.where((self.symbol == 0) & ac, 64, run)
        self.quick = np.where((total <= 16) & (self.length > 0) & ~((size == 0) & (run > 0) & (run < 15)), (value << 12) | (run << 5) | total, -(1 << 30)).astype(np.int32)


def extended(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)


SLOW = -(1 << 30)


class Bits:
    """Bytes without stuffing, from which many places can be read at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.full(16, 255, np.uint8)]).astype(np.uint32)
        self.words = padded[:-3] << np.uint32(24)
        for k, shift in ((1, 16), (2, 8), (3, 0)):
            self.words |= padded[k : len(padded) - 3 + k] << np.uint32(shift)
        self.most = 8 * len(data) + 64

    def peek16(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    def read(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits, up to 16, from each place."""
        return self.peek16(at).astype(np.int64) >> (16 - n)


class Lanes:
    """The restart segments of one kind of scan over many files: first bit, and the blocks of each in order."""

    def __init__(self, bits: Bits, start: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.bits, self.start, self.first, self.count = bits, start, first, count


def slow_values(bits: Bits, table: Huffman, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits' value and bits used, for codes that with their extra bits take over 16."""
    peek = bits.peek16(at)
    symbol, length = table.symbol[peek].astype(np.int64), table.length[peek].astype(np.int64)
    size = symbol & 15
    eob = (size == 0) & (symbol < 0xF0)
    n = np.where(eob, symbol >> 4, size)
    return symbol, bits.read(at + length, n), np.where(length > 0, length + n, 16)


def decode_ac_first(lanes: Lanes, table: Huffman, target: np.ndarray, place: np.ndarray, ss: int, se: int, al: int) -> None:
    """target: flat coefficients with a spare one at the end; place: where each block of the lanes begins in it."""
    spare, bits, quick = len(target) - 1, lanes.bits, table.quick
    order = np.argsort(-lanes.count, kind="stable")
    at, block, end = lanes.start[order].copy(), lanes.first[order].copy(), (lanes.first + lanes.count)[order]
    base, k = place[block], np.full(len(order), ss)
    while len(at):
        e = quick[bits.peek16(at)]
        slow = np.flatnonzero(e == SLOW)
        skip = None
        if len(slow):
            symbol, extra, used = slow_values(bits, table, at[slow])
            eob = (symbol & 15 == 0) & (symbol < 0xF0)
            value = np.where(eob, 0, extended(extra, symbol & 15))
            e[slow] = value << 12 | np.where(eob, 64, symbol >> 4) << 5 | used
            skip = np.where(eob, (1 << (symbol >> 4)) + extra - 1, 0)
        at += e & 31
        k += (e >> 5) & 127
        full = k > se
        spot = base + k
        spot[full] = spare
        target[spot] = (e >> 12) << al
        k += 1
        full |= k > se
        done = np.flatnonzero(full)
        if len(done):
            block[done] += 1
            if skip is not None:
                block[slow] += skip
            k[done] = ss
            going = block < end
            if not going.all() or at.max() > bits.most - 32:
                going &= at < bits.most - 32
                at, block, end, k, base = at[going], block[going], end[going], k[going], base[going]
                done = slice(None)
            base[done] = place[block[done]]


def decode_ac_refine(lanes: Lanes, table: Huffman, target: np.ndarray, place: np.ndarray, ss: int, se: int, al: int) -> None:
    bits = lanes.bits
    at, block, end = lanes.start.copy(), lanes.first.copy(), lanes.first + lanes.count
    n = len(at)
    k, run, fresh, eob = np.full(n, ss), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    one = 1 << al
    while len(at):
        need = np.flatnonzero((run < 0) & (eob == 0))
        if len(need):
            peek = bits.peek16(at[need])
            symbol, length = table.symbol[peek].astype(np.int64), np.maximum(table.length[peek], 1).astype(np.int64)
            r, s = symbol >> 4, symbol & 15
            at[need] += length
            ends = (s == 0) & (r < 15)
            extra = bits.read(at[need], np.where(ends, r, np.minimum(s, 1)))
            at[need] += np.where(ends, r, np.minimum(s, 1))
            eob[need] = np.where(ends, (1 << r) + extra, 0)
            run[need] = np.where(ends, -1, r)
            fresh[need] = np.where(ends | (s == 0), 0, np.where(extra == 1, one, -one))
        spot = place[block] + k
        now = target[spot].astype(np.int64)
        old = now != 0
        bit = bits.read(at, np.ones(len(at), np.int64))
        at += old
        now += np.where(old & (bit == 1) & (np.abs(now) & one == 0), np.where(now > 0, one, -one), 0)
        here = ~old & (run == 0)
        now = np.where(here, fresh, now)
        target[spot] = now
        run -= ~old & (run >= 0)
        k += 1
        full = k > se
        k[full] = ss
        block += full
        eob -= full & (eob > 0)
        run[full & (run >= 0)] = -1
        going = (block < end) & (at < bits.most - 32)
        if not going.all():
            at, block, end, k, run, fresh, eob = (x[going] for x in (at, block, end, k, run, fresh, eob))


def decode_dc_first(lanes: Lanes, tables: list[Huffman], target: np.ndarray, place: np.ndarray, component: np.ndarray, al: int) -> None:
    """component: of each block of an MCU, with as many tables."""
    at, bits = lanes.start.copy(), lanes.bits
    before = np.zeros((len(at), max(component) + 1), np.int64)
    width = len(component)
    for k in range(int(lanes.count.max()) if len(at) else 0):
        on = np.flatnonzero(lanes.count > k)
        t, c = tables[k % width], component[k % width]
        e = t.quick[bits.peek16(np.minimum(at[on], bits.most - 32))]
        slow = np.flatnonzero(e == SLOW)
        if len(slow):
            size = t.symbol[bits.peek16(at[on[slow]])].astype(np.int64)
            length = t.length[bits.peek16(at[on[slow]])].astype(np.int64)
            e[slow] = extended(bits.read(at[on[slow]] + length, size), size) << 12 | (length + size)
        at[on] += e & 31
        before[on, c] += e >> 12
        target[place[lanes.first[on] + k]] = before[on, c] << al


class File:
    """A parsed file: its shape, quantisers, and scans as (header, tables, where its bytes are)."""

    def __init__(self, raw: bytes):
        self.raw, self.scans, self.comment = raw, [], b""
        quantisers: dict[int, np.ndarray] = {}
        huffman: dict[int, bytes] = {}
        at, restart = 2, 0
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while at + 1 < len(raw):
            marker, (size,) = raw[at + 1], struct.unpack_from(">H", raw, at + 2) if raw[at + 1] != 0xD9 else (0,)
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xD9:
                break
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    huffman[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or n not in (1, 3):
                    raise ValueError("only 8-bit files with one or three components")
                self.ids = [body[6 + 3 * k] for k in range(n)]
                self.shape = Shape(width, height, [(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) if n > 1 else (1, 1) for k in range(n)])
                which = [body[8 + 3 * k] for k in range(n)]
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman file")
            elif marker == 0xDA:
                n = body[0]
                components = tuple(self.ids.index(body[1 + 2 * k]) for k in range(n))
                tables = tuple(body[2 + 2 * k] for k in range(n))
                ss, se, a = body[1 + 2 * n : 4 + 2 * n]
                end = AFTER_SCAN.search(raw, at)
                stop = end.start() if end else len(raw)
                used = tuple(huffman.get(t >> 4 if se == 0 else 16 | t & 15, b"") for t in tables)
                self.scans.append(((components, ss, se, a >> 4, a & 15, restart, used), at, stop))
                at = stop
        else:
            raise ValueError("the file ends before its end marker")
        self.quantisers = [quantisers[q] for q in which]

    def whole(self) -> bool:
        """Whether the scans send every bit of every coefficient."""
        low = np.full((len(self.ids), 64), 99)
        for (components, ss, se, _, al, *_), *_ in self.scans:
            low[list(components), ss : se + 1] = np.minimum(low[list(components), ss : se + 1], al)
        return not low.any()


AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
_tables: dict[tuple[bytes, bool], Huffman] = {}


def table_for(spec: bytes, ac: bool) -> Huffman:
    if (spec, ac) not in _tables:
        _tables[spec, ac] = Huffman(list(spec[:16]), list(spec[16:]), ac)
    return _tables[spec, ac]


def coefficients(files: list[File]) -> list[list[np.ndarray]]:
    """For each file the coefficients of its components, blocks by 64 in zigzag order, from all of its scans."""
    bases, total = [], 0
    for f in files:
        bases.append(list(np.cumsum([total, *(64 * b for b in f.shape.blocks)])))
        total = bases[-1].pop()
    target = np.zeros(total + 1, np.int16)
    for turn in range(max((len(f.scans) for f in files), default=0)):
        kinds = defaultdict(list)
        for k, f in enumerate(files):
            if turn < len(f.scans):
                kinds[f.scans[turn][0]].append(k)
        for kind, members in kinds.items():
            decode_scan(kind, [files[k] for k in members], [bases[k] for k in members], turn, target)
    return [[target[b : b + 64 * n].reshape(n, 64) for b, n in zip(base, f.shape.blocks, strict=True)] for f, base in zip(files, bases, strict=True)]


def decode_scan(kind: tuple, files: list[File], bases: list[list[int]], turn: int, target: np.ndarray) -> None:
    components, ss, se, ah, al, restart, specs = kind
    places, counts, units = [], [], []
    for f, base in zip(files, bases, strict=True):
        c, b, n = order_of(f.shape, components)
        places.append(np.array(base)[c] + 64 * b)
        counts.append(len(b))
        units.append((n * restart) or len(b))
    component = c[:n]
    place, counts, units = np.concatenate(places), np.array(counts), np.array(units)
    sizes = np.array([f.scans[turn][2] - f.scans[turn][1] for f in files])
    data = np.frombuffer(b"".join(f.raw[f.scans[turn][1] : f.scans[turn][2]] for f in files), np.uint8)
    after = np.zeros(len(data), np.uint8)
    after[:-1] = data[1:]
    after[np.cumsum(sizes)[sizes > 0] - 1] = 0xFF  # nothing belongs to the last byte of a scan
    mark = data == 0xFF
    restarts = np.flatnonzero(mark & (after >= 0xD0) & (after <= 0xD7))
    scan_starts = np.cumsum(sizes) - sizes
    segments = -(-counts // units)
    owner = np.repeat(np.arange(len(files)), segments)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    starts = np.sort(np.concatenate([scan_starts, restarts + 2]))
    where = np.searchsorted(scan_starts, starts, side="right") - 1
    if len(starts) != len(owner) or (where != owner).any():
        raise ValueError("a scan has another number of restart segments than its blocks need")
    if (after[restarts] != 0xD0 + (nth[nth > 0] - 1) % 8).any():
        raise ValueError("restart markers are out of order")
    first = (np.cumsum(counts) - counts)[owner] + nth * units[owner]
    count = np.minimum(units[owner], counts[owner] - nth * units[owner])
    ends = np.append(starts[1:], len(data))
    for a in range(0, len(starts), LOT):  # segments of a lot
        some = slice(a, a + LOT)
        lo, hi = int(starts[a]), int(ends[some][-1])
        here, there = restarts[(restarts >= lo) & (restarts < hi)] - lo, np.flatnonzero(mark[lo:hi] & (after[lo:hi] == 0)) + 1
        keep = np.ones(hi - lo, bool)
        keep[there] = False
        keep[here], keep[here + 1] = False, False
        upto = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        lanes = Lanes(Bits(data[lo:hi][keep]), 8 * upto[starts[some] - lo], first[some], count[some])
        if se == 0 and ah == 0:
            tables = [table_for(specs[components.index(x)], False) for x in component]
            decode_dc_first(lanes, tables, target, place, component, al)
        elif se == 0:
            n = lanes.count
            at = np.repeat(lanes.start - np.cumsum(n) + n, n) + np.arange(n.sum())
            blocks = np.repeat(lanes.first - np.cumsum(n) + n, n) + np.arange(n.sum())
            target[place[blocks]] |= (lanes.bits.read(np.minimum(at, lanes.bits.most - 32), np.ones(len(at), np.int64)) << al).astype(np.int16)
        elif ah == 0:
            decode_ac_first(lanes, table_for(specs[0], True), target, place, ss, se, al)
        else:
            decode_ac_refine(lanes, table_for(specs[0], True), target, place, ss, se, al)


def transform() -> np.ndarray:
    """The inverse cosine transform in fixed point of 12 bits: rows are samples, columns frequencies. Sums of its
    products stay below 2 ** 53, so float64 products are exact in any order."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.rint(4096 * np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, 8**-0.5, 0.5))


INVERSE = transform()


def samples(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """8 x 8 samples from 0 to 255 of blocks of zigzag coefficients."""
    square = np.empty((len(blocks), 64))
    square[:, ZIGZAG] = blocks * quantiser
    rows = (square.reshape(-1, 8) @ INVERSE.T).reshape(-1, 8, 8)
    out = np.matmul(INVERSE, rows).reshape(-1, 8, 8)
    return np.clip(np.floor(out / (1 << 24) + 0.5) + 128, 0, 255).astype(np.int32)


def planes_to_rgb(shape: Shape, planes: list[np.ndarray]) -> np.ndarray:
    """The tensor (height, width, 3) of a file from the samples of its components."""
    full = []
    for (h, v), wide, p in zip(shape.factors, shape.wide, planes, strict=True):
        plane = p.reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * wide)
        plane = plane.repeat(shape.v // v, 0).repeat(shape.h // h, 1) if (h, v) != (shape.h, shape.v) else plane
        full.append(plane[: shape.height, : shape.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    rgb = np.stack([y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def bands(files: list[File], found: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Full-resolution RGB of files: (file, some of its rows), in order. Files of under BAND blocks come whole; their
    blocks that share a quantiser are transformed together. Larger ones come in bands of MCU rows."""
    groups, small = defaultdict(list), [sum(f.shape.blocks) < BAND for f in files]
    for k, f in enumerate(files):
        for c, q in enumerate(f.quantisers if small[k] else ()):
            groups[q.tobytes()].append((k, c))
    done: dict[tuple[int, int], np.ndarray] = {}
    for q, members in groups.items():
        parts = [found[k][c] for k, c in members]
        all_samples = samples(np.concatenate(parts), np.frombuffer(q, np.int64))
        for (k, c), s in zip(members, np.split(all_samples, np.cumsum([len(p) for p in parts])[:-1]), strict=True):
            done[k, c] = s
    for k, f in enumerate(files):
        if small[k]:
            yield k, planes_to_rgb(f.shape, [done[k, c] for c in range(len(f.quantisers))])
            continue
        s = f.shape
        step = max(1, BAND // 2 * s.my // sum(s.blocks))
        for r in range(0, s.my, step):
            rows = min(step, s.my - r)
            part = Shape(s.width, min(8 * s.v * rows, s.height - 8 * s.v * r), s.factors)
            planes = [samples(p[r * v * wide : (r + rows) * v * wide], q) for p, (_, v), wide, q in zip(found[k], s.factors, s.wide, f.quantisers, strict=True)]
            yield k, planes_to_rgb(part, planes)


def tensors(files: list[File], found: list[list[np.ndarray]]) -> list[np.ndarray]:
    out = [np.empty((f.shape.height, f.shape.width, 3), np.uint8) for f in files]
    filled = [0] * len(files)
    for k, rgb in bands(files, found):
        out[k][filled[k] : filled[k] + len(rgb)] = rgb
        filled[k] += len(rgb)
    return out


def payload_of(f: File, planes: list[np.ndarray]) -> bytes:
    if not f.whole():
        raise ValueError("scans are missing")
    n = int(f.comment.split()[1])
    _, b, width = order_of(f.shape, (0, 1, 2))
    by = b.reshape(-1, width)
    mcus = np.empty((len(by), 6, 64), np.int16)
    mcus[:, :4] = planes[0][by[:, :4]]
    mcus[:, 4], mcus[:, 5] = planes[1][by[:, 4]], planes[2][by[:, 5]]
    return (mcus + 128).astype(np.uint8).tobytes()[:n]


def features(files: list[File], found: list[list[np.ndarray]]) -> list[str]:
    """Size, and the sums of each channel and of its squares, of the tensors."""
    sums = np.zeros((len(files), 6), np.int64)
    for k, rgb in bands(files, found):
        flat = rgb.reshape(-1, 3).astype(np.int64)
        sums[k] += np.concatenate([flat.sum(0), (flat * flat).sum(0)])
    return [f"{f.shape.height}x{f.shape.width}x3 " + " ".join(map(str, s)) for f, s in zip(files, sums.tolist(), strict=True)]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_jpeg(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and jpeg, the text's bytes as a progressive JPEG file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            done = 0
            for part in chunks(batch.column(1), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(encode([padded(t)[1] for t in part.to_pylist()]), pa.binary())], [key, "jpeg"])
                done += len(part)

    return docs.select(key, text).mapInArrow(rows, f"{key} {docs.schema[key].dataType.simpleString()}, jpeg binary")


def to_tensors(files: DataFrame, jpeg: str = "jpeg", key: str = "doc_id") -> DataFrame:
    """key, height, width and rgb, the bytes of the full-resolution tensor, of progressive JPEG files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            done = 0
            for part in chunks(batch.column(1), CHUNK):
                parsed = [File(x) for x in part.to_pylist()]
                out = tensors(parsed, coefficients(parsed))
                columns = [pa.array([t.shape[d] for t in out], pa.int32()) for d in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), *columns, pa.array([t.tobytes() for t in out], pa.binary())], [key, "height", "width", "rgb"])
                done += len(part)

    return files.select(key, jpeg).mapInArrow(rows, f"{key} {files.schema[key].dataType.simpleString()}, height int, width int, rgb binary")


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What op2 returns. Each text is stored as a file in a table of the shared folder; all that follows is made of what is
    read back from there."""
    sizes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    stored = cut(to_jpeg(docs.select(F.struct(F.col(key).alias("doc_id"), sizes.alias("n_bytes")).alias("doc_id"), F.col(text).alias("text"))), compression="zstd")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            done = 0
            for part in chunks(batch.column(2), CHUNK):
                media = part.to_pylist()
                files = [File(x) for x in media]
                found = coefficients(files)
                back = [payload_of(f, c) for f, c in zip(files, found, strict=True)]
                columns = [
                    pa.array([len(b) for b in back], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array(features(files, found)),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(done, len(part)) for k in (0, 1)), *columns], NAMES)
                done += len(part)

    return stored.select("doc_id.doc_id", "doc_id.n_bytes", "jpeg").mapInArrow(rows, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    return media_digests(table(spark, sf_dir, "documents"))
