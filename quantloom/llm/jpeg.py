"""Progressive JPEG: scans accumulate into coefficient arrays, numpy turns them into RGB.

The decoder takes Huffman-coded progressive files with any scan script.  Scans
whose codes all have one total width, and refinements inside end-of-band runs,
are read as arrays; other scans symbol by symbol.  The encoder writes bytes as
coefficients, which JPEG keeps exactly.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

MCU_COLUMNS = 1024
LUMA_BANDS, CHROMA_BANDS = ((1, 5), (6, 63)), ((1, 63),)


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals, alternately downwards and upwards."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()
_K = np.arange(8)
DCT = (np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)).astype(np.float32)


# ---- codes -------------------------------------------------------------------------------


def _canonical(lengths: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """{(length, code): symbol} for the number of codes of each length 1 to 16 and the symbols in order."""
    table, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            table[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _dht(kind: int, widths: dict[int, int]) -> bytes:
    """A table of symbols with the code lengths asked for."""
    order = sorted(widths, key=lambda s: (widths[s], s))
    counts = bytes(sum(w == n for w in widths.values()) for n in range(1, 17))
    return b"\xff\xc4" + struct.pack(">HB", 19 + len(order), kind) + counts + bytes(order)


def _codes(widths: dict[int, int]) -> dict[int, tuple[int, int]]:
    order = sorted(widths, key=lambda s: (widths[s], s))
    counts = [sum(w == n for w in widths.values()) for n in range(1, 17)]
    return {s: (n, c) for (n, c), s in _canonical(counts, order).items()}


def _fields(widths: dict[int, int], total: int, low: int, high: int) -> np.ndarray:
    """Code and magnitude bits, ``total`` together, of each value from low to high; symbol = size."""
    codes, out = _codes(widths), np.zeros(high - low + 1, np.uint16)
    for v in range(low, high + 1):
        size = abs(v).bit_length()
        if size in codes:
            out[v - low] = codes[size][1] << (total - codes[size][0]) | ((v if v > 0 else v + (1 << size) - 1) if size else 0)
    return out


# Codes of 8 bits with magnitude for values of 1 to 7 bits, and of 9 bits for differences of 0 to 8 bits.
AC_WIDTHS, AC_TOTAL = {s: 8 - s for s in range(1, 8)}, 8
DC_WIDTHS, DC_TOTAL = {s: 9 - s for s in range(9)}, 9
RUN_WIDTHS = {n << 4: 5 for n in range(15)}
TABLES, RUNS = _dht(0x00, DC_WIDTHS) + _dht(0x10, AC_WIDTHS) + _dht(0x11, RUN_WIDTHS), _codes(RUN_WIDTHS)
AC_FIELDS, DC_FIELDS = _fields(AC_WIDTHS, AC_TOTAL, -127, 127).astype(np.uint8), _fields(DC_WIDTHS, DC_TOTAL, -255, 255)
#: Byte to coefficient and back: no coefficient is under 2 in size, so that none is new in the refining scans.
TO_COEFFICIENT = np.array([b - 130 if b < 128 else b - 126 for b in range(256)], np.int16)
BIAS = 130
TO_BYTE = np.zeros(2 * BIAS, np.uint8)
TO_BYTE[TO_COEFFICIENT + BIAS] = np.arange(256)


# ---- writing -----------------------------------------------------------------------------


def _scan(component: int, dc: int, ac: int, band: tuple[int, int], ah: int, al: int, bits_or_bytes: np.ndarray, packed: bool = False) -> bytes:
    if not packed:
        spare = -len(bits_or_bytes) % 8
        bits_or_bytes = np.packbits(np.concatenate([bits_or_bytes, np.ones(spare, np.uint8)]))
    head = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, component, dc << 4 | ac, *band, ah << 4 | al)
    return head + bits_or_bytes.tobytes().replace(b"\xff", b"\xff\x00")


def encode_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose coefficients are the payload's bytes; a comment keeps its length."""
    blocks = max(1, -(-len(payload) // 64))
    rows = -(-(-(-blocks // 6)) // MCU_COLUMNS)
    columns = -(-(-(-blocks // 6)) // rows)
    n = rows * columns
    data = np.full(n * 384, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = np.split(TO_COEFFICIENT[data].reshape(-1, 64), [4 * n, 5 * n])
    out = [
        b"\xff\xd8\xff\xfe", struct.pack(">H", 2 + len(note := b"bytes %d" % len(payload))), note,
        b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64,
        b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]),
        TABLES,
    ]
    for c, plane in enumerate(planes, 1):
        bands = LUMA_BANDS if c == 1 else CHROMA_BANDS
        steps = DC_FIELDS[np.diff(plane[:, 0] >> 1, prepend=np.int16(0)) + 255]
        out.append(_scan(c, 0, 0, (0, 0), 0, 1, (steps[:, None] >> np.arange(DC_TOTAL - 1, -1, -1) & 1).astype(np.uint8).ravel()))
        size = np.abs(plane)
        first = AC_FIELDS[np.sign(plane) * (size >> 1) + 127]
        for band in bands:
            out.append(_scan(c, 0, 0, band, 0, 1, np.ascontiguousarray(first[:, band[0] : band[1] + 1]), True))
        out.append(_scan(c, 0, 0, (0, 0), 1, 0, (plane[:, 0] & 1).astype(np.uint8)))
        for band in bands:
            bits = []
            for low in range(0, len(plane), 32767):
                part = size[low : low + 32767, band[0] : band[1] + 1] & 1
                extra = len(part).bit_length() - 1
                width, code = RUNS[extra << 4]
                head = (code << extra) | (len(part) - (1 << extra))
                bits += [np.array([head >> k & 1 for k in range(width + extra - 1, -1, -1)], np.uint8), part.astype(np.uint8).ravel()]
            out.append(_scan(c, 0, 1, band, 1, 0, np.concatenate(bits)))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading -----------------------------------------------------------------------------


class Bits:
    """The bits of one entropy-coded segment; beyond its end they are zeros."""

    def __init__(self, data: bytes):
        self.raw, self.at = data, 0
        self._bits: np.ndarray | None = None

    @property
    def array(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.raw, np.uint8))
        return self._bits

    def take(self, n: int) -> np.ndarray:
        found = self.array[self.at : self.at + n]
        self.at += n
        return found if len(found) == n else np.concatenate([found, np.zeros(n - len(found), np.uint8)])

    def number(self, n: int) -> int:
        v = 0
        for b in self.take(n):
            v = v << 1 | int(b)
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.number(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def fields(self, count: int, width: int) -> np.ndarray:
        """``count`` numbers of ``width`` bits."""
        if width == 8 and self.at == 0 and len(self.raw) >= count:
            self.at = 8 * count
            return np.frombuffer(self.raw, np.uint8, count)
        return self.take(count * width).reshape(count, width) @ (1 << np.arange(width - 1, -1, -1))


def _signed(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


@lru_cache(64)
def _table(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    return _canonical(list(lengths), list(symbols))


def _uniform(table: dict[tuple[int, int], int], most: int) -> tuple[int, np.ndarray] | None:
    return _even(tuple(table.items()), most)


@lru_cache(64)
def _even(codes: tuple, most: int) -> tuple[int, np.ndarray] | None:
    """(width, value of each field) if every symbol is a size of at most ``most`` and all codes with their bits are equally wide."""
    table = dict(codes)
    widths = {n + s for (n, _), s in codes}
    if len(widths) != 1 or max(table.values()) > most:
        return None
    (width,) = widths
    values = np.zeros(1 << width, np.int32)
    for (n, code), s in table.items():
        values[(code << s) : (code + 1) << s] = [_signed(v, s) for v in range(1 << s)]
    return width, values


@dataclass
class Component:
    h: int
    v: int
    table: int
    shape: tuple[int, int] = (0, 0)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Image:
    height: int
    width: int
    components: dict[int, Component]
    quantisation: dict[int, np.ndarray]
    comment: bytes = b""

    @property
    def most(self) -> tuple[int, int]:
        return max(c.v for c in self.components.values()), max(c.h for c in self.components.values())

    def payload(self) -> bytes:
        """The bytes that ``encode_payload`` stored."""
        stored = np.concatenate([c.coefficients[: c.shape[0], : c.shape[1]].reshape(-1, 64) for c in self.components.values()])
        return TO_BYTE[stored + BIAS].tobytes()[: int(self.comment.split()[1])]

    def rgb_strips(self) -> Iterator[np.ndarray]:
        """Full-resolution RGB, one row of MCUs at a time, as uint8 (height, width, 3)."""
        vmax, hmax = self.most
        for r in range(-(-self.height // (8 * vmax))):
            planes = []
            for c in self.components.values():
                blocks = c.coefficients[r * c.v : (r + 1) * c.v]
                natural = np.zeros(blocks.shape, np.float32)
                natural[..., ZIGZAG] = blocks * self.quantisation[c.table]
                n = natural.shape[0] * natural.shape[1]
                half = (natural.reshape(n * 8, 8) @ DCT).reshape(n, 8, 8).transpose(0, 2, 1)
                pixels = (np.ascontiguousarray(half).reshape(n * 8, 8) @ DCT).reshape(*natural.shape[:2], 8, 8)
                plane = pixels.transpose(0, 3, 1, 2).reshape(natural.shape[0] * 8, -1)
                planes.append(plane.repeat(vmax // c.v, 0).repeat(hmax // c.h, 1)[: self.height - r * 8 * vmax, : self.width])
            if len(planes) == 1:
                planes += [np.zeros_like(planes[0])] * 2
            y, cb, cr = planes
            y = y + 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
            yield np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        return np.concatenate(list(self.rgb_strips()))


@dataclass
class Scan:
    """What one scan adds to the coefficients of its components."""

    image: Image
    members: list[tuple[Component, dict, dict]]
    band: tuple[int, int]
    ah: int
    al: int
    restart: int

    def units(self) -> list[list[tuple[int, int, int]]]:
        """(member, row, column) of the blocks of each unit, in order."""
        if len(self.members) == 1:
            rows, columns = self.members[0][0].shape
            return [[(0, r, c)] for r in range(rows) for c in range(columns)]
        vmax, hmax = self.image.most
        rows, columns = -(-self.image.height // (8 * vmax)), -(-self.image.width // (8 * hmax))
        return [[(m, r * x.v + i, c * x.h + j) for m, (x, _, _) in enumerate(self.members) for i in range(x.v) for j in range(x.h)] for r in range(rows) for c in range(columns)]

    def read(self, segments: list[bytes]) -> None:
        if self.restart == 0 and len(self.members) == 1 and self._whole(Bits(segments[0])):
            return
        units = self.units()
        step = self.restart or len(units)
        for k, data in enumerate(segments):
            bits, run, last = Bits(data), 0, [0] * len(self.members)
            for unit in units[k * step : (k + 1) * step]:
                for m, r, c in unit:
                    part, dc, ac = self.members[m]
                    block = part.coefficients[r, c]
                    if self.band[0] > 0:
                        run = self._refine(bits, block, ac, run) if self.ah else self._first(bits, block, ac, run)
                    elif self.ah:
                        block[0] |= bits.number(1) << self.al
                    else:
                        size = bits.symbol(dc)
                        last[m] += _signed(bits.number(size), size)
                        block[0] = last[m] << self.al

    def _whole(self, bits: Bits) -> bool:
        """The scan of one component as arrays, where its codes allow."""
        part, dc, ac = self.members[0]
        (rows, columns), (low, high) = part.shape, self.band
        view = part.coefficients[:rows, :columns]
        n = rows * columns
        if low == 0 and self.ah:
            view[..., 0] |= bits.take(n).reshape(rows, columns).astype(np.int32) << self.al
        elif low == 0:
            if (even := _uniform(dc, 11)) is None:
                return False
            view[..., 0] = np.cumsum(even[1][bits.fields(n, even[0])]).reshape(rows, columns) << self.al
        elif not self.ah:
            if (even := _uniform(ac, 10)) is None or 0 in ac.values():
                return False
            view[..., low : high + 1] = even[1][bits.fields(n * (high - low + 1), even[0])].reshape(rows, columns, -1) * (1 << self.al)
        else:
            blocks, at = view[..., low : high + 1].reshape(n, -1), 0
            while at < n:
                symbol = bits.symbol(ac)
                size, log = symbol & 15, symbol >> 4
                if size or log == 15:
                    return False
                run = (1 << log) + bits.number(log)
                self._correct(bits, blocks[at : at + run])
                at += run
            view[..., low : high + 1] = blocks.reshape(rows, columns, -1)
        return True

    def _correct(self, bits: Bits, band: np.ndarray) -> None:
        """One bit for each coefficient that is not zero, in order."""
        known = band != 0
        if known.all():
            band += np.sign(band) * (bits.take(band.size).reshape(band.shape).astype(np.int32) << self.al)
        else:
            old = band[known]
            band[known] = old + np.sign(old) * (bits.take(len(old)).astype(np.int32) << self.al)

    def _first(self, bits: Bits, block: np.ndarray, ac: dict, run: int) -> int:
        if run:
            return run - 1
        k = self.band[0]
        while k <= self.band[1]:
            symbol = bits.symbol(ac)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                block[k] = _signed(bits.number(size), size) * (1 << self.al)
                k += 1
            elif skip == 15:
                k += 16
            else:
                return (1 << skip) + bits.number(skip) - 1
        return 0

    def _refine(self, bits: Bits, block: np.ndarray, ac: dict, run: int) -> int:
        k, high = self.band
        while not run and k <= high:
            symbol = bits.symbol(ac)
            skip, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = (1 if bits.number(1) else -1) << self.al
            elif skip < 15:
                run = (1 << skip) + bits.number(skip)
                break
            while k <= high:
                if block[k]:
                    self._correct(bits, block[k : k + 1])
                elif skip == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    skip -= 1
                k += 1
        if run:
            self._correct(bits, block[k : high + 1])
            run -= 1
        return run


def decode(data: bytes) -> Image:
    """Accumulate all scans of a progressive file."""
    image, tables, quantisation, comment, restart, at = None, {}, {}, b"", 0, 2
    marker_after = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
    while at < len(data):
        kind, size = data[at + 1], 0
        if kind == 0xD9:
            break
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 64 << wide
                quantisation[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            image = Image(height, width, parts, quantisation)
            vmax, hmax = image.most
            for c in parts.values():
                c.shape = (-(-height * c.v // (8 * vmax)), -(-width * c.h // (8 * hmax)))
                c.coefficients = np.zeros((-(-height // (8 * vmax)) * c.v, -(-width // (8 * hmax)) * c.h, 64), np.int32)
        elif kind in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
        elif kind == 0xDA:
            n = body[0]
            members = [(image.components[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4, {}), tables.get(0x10 | body[2 + 2 * i] & 15, {})) for i in range(n)]
            low, high, approximation = body[1 + 2 * n : 4 + 2 * n]
            end = marker_after.search(data, at)
            coded = data[at : end.start() if end else len(data)]
            segments = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", coded)]
            Scan(image, members, (low, high), approximation >> 4, approximation & 15, restart).read(segments)
            at += len(coded)
    image.comment = comment
    return image
