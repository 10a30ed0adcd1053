"""A small progressive JPEG coder in numpy: coefficient arrays in and out, 4:2:0, Huffman, any scan script on reading.

Reading accumulates spectral-selection and successive-approximation scans into one coefficient array a component.
Scans whose Huffman table gives every coefficient the same number of bits (those written here) are read as arrays;
any others go through the bit reader.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Fixed values of the JPEG standard: the zigzag order of an 8x8 block.
ZIGZAG = np.array(
    sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64
)
#: Markers (fixed values of the JPEG standard).
SOI, SOF2, DHT, EOI, SOS, DQT, DRI, COM = 0xD8, 0xC2, 0xC4, 0xD9, 0xDA, 0xDB, 0xDD, 0xFE

#: Tables written here: code length + value bits is one number for all symbols of a table.
_DC_BITS, _AC_BITS = 9, 8
_DC_TABLE = {size: _DC_BITS - size for size in range(9)}
_AC_TABLE = {size: _AC_BITS - size for size in range(1, 8)}
_REFINE_TABLE = {0: 1}

_k = np.arange(8)
_COSINE = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k[:, None] == 0, np.sqrt(0.125), 0.5)
_COSINE = _COSINE.astype(np.float32)  # [frequency, sample]


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, last = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        out[symbol], code, last = (code, length), code + 1, length
    return out


def _magnitude_bits(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return size, v if v > 0 else v + (1 << size) - 1


def _value_code(v: int, table: dict[int, int]) -> int:
    size, bits = _magnitude_bits(v)
    return _codes(table)[size][0] << size | bits


_AC_CODE = np.array([0 if v == 0 else _value_code(v, _AC_TABLE) for v in range(-64, 65)], np.uint8)
_DC_CODE = np.array([_value_code(v, _DC_TABLE) for v in range(-255, 256)], np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == i for n in lengths.values()) for i in range(1, 17)]
    return bytes([kind << 4 | slot, *counts, *symbols])


_TABLES = _segment(DHT, _huffman(0, 0, _DC_TABLE) + _huffman(1, 0, _AC_TABLE) + _huffman(1, 1, _REFINE_TABLE))
_PLACES = 1 << np.arange(_DC_BITS - 1, -1, -1)
_FLAT = _segment(DQT, bytes([0]) + bytes([1] * 64))


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([first, last, high << 4 | low])
    return _segment(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Bits to bytes, padded with ones."""
    short = -len(bits) % 8
    return np.packbits(np.append(bits, np.ones(short, np.uint8)) if short else bits).tobytes()


def _mcu_order(planes: list[np.ndarray]) -> np.ndarray:
    """Values of the blocks of Y (2x2 a unit), Cb and Cr as interleaved scans have them: units by 6."""
    y, cb, cr = planes
    rows, cols = cb.shape
    y = y.reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(rows * cols, 4)
    return np.concatenate([y, cb.reshape(-1, 1), cr.reshape(-1, 1)], axis=1)


def encode(planes: list[np.ndarray], note: bytes = b"") -> bytes:
    """A progressive 4:2:0 file of the coefficients: Y (2r, 2c, 64), Cb and Cr (r, c, 64), int16 in zigzag order.

    AC coefficients must have magnitudes of 2 to 129, DC of 0 to 129 (so no coefficient is zero after the first
    scan's shift, and all symbols have one length).
    """
    rows, cols = planes[1].shape[:2]
    out = [b"\xff\xd8", _segment(COM, note), _FLAT]
    out.append(_segment(SOF2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_TABLES)
    dc = _mcu_order([p[:, :, 0] for p in planes]).astype(np.int32)
    low = dc >> 1
    steps = np.empty_like(low)
    for span in (slice(0, 4), slice(4, 5), slice(5, 6)):
        flat = low[:, span].ravel()
        steps[:, span] = np.diff(flat, prepend=0).reshape(-1, flat.size // len(low))
    codes = _DC_CODE[steps.ravel() + 255]
    bits = (codes[:, None] >> np.arange(_DC_BITS - 1, -1, -1, dtype=np.uint16)) & 1
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, _pack(bits.astype(np.uint8).ravel())))
    flat = [p.reshape(-1, 64) for p in planes]
    size = [np.abs(p) for p in flat]
    halves = [_AC_CODE[np.sign(p) * (s >> 1) + 64] for p, s in zip(flat, size, strict=True)]
    for c, a, b in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        out.append(_scan([(c + 1, 0)], a, b, 0, 1, halves[c][:, a : b + 1].tobytes()))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, _pack((dc & 1).astype(np.uint8).ravel())))
    for c in range(3):
        fix = (size[c] & 1).astype(np.uint8)
        fix[:, 0] = 0  # the one-bit code of "rest of this block"
        out.append(_scan([(c + 1, 1)], 1, 63, 1, 0, np.packbits(fix).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Bit by bit reading, for tables that arrays can't read."""

    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (int(self.data[self.at]) if self.at < len(self.data) else 1)
            self.at += 1
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (code, length) in codes:
                return codes[code, length]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


_tables: dict[tuple, np.ndarray | None] = {}


def _uniform(codes: dict[tuple[int, int], int], bits: int, least: int) -> np.ndarray | None:
    """As _uniform_table; a few tables are kept, as files of one writer share theirs."""
    key = (*codes.items(), bits, least)
    if key not in _tables:
        if len(_tables) > 32:
            _tables.clear()
        _tables[key] = _uniform_table(codes, bits, least)
    return _tables[key]


def _uniform_table(codes: dict[tuple[int, int], int], bits: int, least: int) -> np.ndarray | None:
    """Values by code word if every symbol is a size of at least `least` with no run and takes `bits` bits in all."""
    if any(s >> 4 or s < least or length + s != bits for (_, length), s in codes.items()):
        return None
    table = np.full(1 << bits, -(1 << 15), np.int16)
    for (code, _), s in codes.items():
        for raw in range(1 << s):
            table[code << s | raw] = raw if s == 0 or raw >> (s - 1) else raw - (1 << s) + 1
    return table


def _ac_first(blocks: np.ndarray, a: int, b: int, low: int, data: bytes, codes) -> None:
    table, n = _uniform(codes, _AC_BITS, 1), len(blocks) * (b - a + 1)
    if table is not None and len(data) == n:
        got = table[np.frombuffer(data, np.uint8)]
        if got.min() > -(1 << 15):
            blocks[:, a : b + 1] = got.reshape(len(blocks), -1) << low
            return
    bits, run = _Bits(data), 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = a
        while k <= b:
            r, s = divmod(bits.symbol(codes), 16)
            if s:
                k += r
                block[k] = bits.value(s) << low
            elif r < 15:
                run = (1 << r) + bits.take(r) - 1
                break
            else:
                k += 15
            k += 1


def _ac_refine(blocks: np.ndarray, a: int, b: int, low: int, data: bytes, codes) -> None:
    part = blocks[:, a : b + 1]
    if list(codes.items()) == [((0, 1), 0)] and (part != 0).all() and len(data) == -(-len(blocks) * (b - a + 2) // 8):
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(blocks) * (b - a + 2)].reshape(len(blocks), -1)
        if not bits[:, 0].any():
            part += np.sign(part) * (bits[:, 1:].astype(np.int16) << low)
            return
    bits, run = _Bits(data), 0

    def fix(block, k):
        if bits.take(1):
            block[k] += (1 if block[k] > 0 else -1) << low

    for block in blocks:
        k = a
        while k <= b and not run:
            r, s = divmod(bits.symbol(codes), 16)
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                break
            new = (1 if bits.take(1) else -1) << low if s else 0
            while k <= b:
                if block[k]:
                    fix(block, k)
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if s and k <= b:
                block[k] = new
            k += 1
        if run:
            for j in range(k, b + 1):
                if block[j]:
                    fix(block, j)
            run -= 1


def _dc(order: list[tuple[int, np.ndarray]], high: int, low: int, data: bytes, tables) -> None:
    """order: for each component its number and its blocks' places in the scan, then values go to them."""
    units = [(c, at.reshape(len(at), -1)) for c, at in order]
    n = sum(at.size for _, at in units)
    if high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(np.int16)
    else:
        table = _uniform(tables[0], _DC_BITS, 0) if all(t == tables[0] for t in tables) else None
        bits = None
        if table is not None and len(data) == -(-n * _DC_BITS // 8):
            raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * _DC_BITS).reshape(n, _DC_BITS)
            bits = table[raw @ _PLACES]
        if bits is None or (n and bits.min() == -(1 << 15)):
            reader, bits, i = _Bits(data), np.zeros(n, np.int16), 0
            for _ in range(len(units[0][1])):
                for (_, at), codes in zip(units, tables, strict=True):
                    for _ in range(at.shape[1]):
                        bits[i] = reader.value(reader.symbol(codes))
                        i += 1
    rows, at0 = bits.reshape(len(units[0][1]), -1), 0
    for (coefficients, at) in units:
        mine = rows[:, at0 : at0 + at.shape[1]]
        at0 += at.shape[1]
        flat = coefficients.reshape(-1, 64)
        if high:
            flat[at.ravel(), 0] |= mine.ravel() << low
        else:
            flat[at.ravel(), 0] = np.cumsum(mine.ravel()) << low


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class Picture:
    """A decoded file: planes (coefficients by component, block rows and columns), quantisers, size, note."""

    def __init__(self, file: bytes):
        self.note, self.planes, quant, codes, at = b"", [], {}, {}, 2
        if file[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker = file[at + 1]
            if marker == EOI:
                return
            (size,) = struct.unpack(">H", file[at + 2 : at + 4])
            body, at = file[at + 4 : at + 2 + size], at + 2 + size
            if marker == COM:
                self.note = body
            elif marker == DQT:
                while body:
                    wide = body[0] >> 4
                    raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    quant[body[0] & 15], body = raw.astype(np.float32), body[65 + 64 * wide :]
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    lengths = [i + 1 for i, c in enumerate(body[1:17]) for _ in range(c)]
                    code, last, table = 0, 0, {}
                    for symbol, length in zip(body[17 : 17 + n], lengths, strict=True):
                        code <<= length - last
                        table[code, length], code, last = symbol, code + 1, length
                    codes[body[0]], body = table, body[17 + n :]
            elif marker == SOF2:
                self.height, self.width, parts = struct.unpack(">xHHB", body[:6])
                self.parts = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(parts)]
                self.factors = [(p[1] >> 4, p[1] & 15) for p in self.parts]
                h, v = (max(f[i] for f in self.factors) for i in (0, 1))
                self.units = -(-self.height // (8 * v)), -(-self.width // (8 * h))
                self.planes = [np.zeros((self.units[0] * y, self.units[1] * x, 64), np.int16) for x, y in self.factors]
                self.most = h, v
            elif marker in (0xC0, 0xC1, DRI):
                raise ValueError("only progressive files without restart intervals are read")
            elif marker == SOS:
                end = _NEXT.search(file, at).start()
                self._read_scan(body, file[at:end].replace(b"\xff\x00", b"\xff"), codes)
                at = end
            if marker == SOF2:
                self.quant = [quant[p[2]] for p in self.parts]

    def _read_scan(self, head: bytes, data: bytes, codes: dict) -> None:
        n = head[0]
        ids = [p[0] for p in self.parts]
        chosen = [(ids.index(head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        a, b, h, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if a == 0:
            order = []
            for c, _ in chosen:
                rows, cols = self.planes[c].shape[:2]
                at = np.arange(rows * cols).reshape(rows, cols)
                x, y = self.factors[c]
                if n > 1:
                    at = at.reshape(rows // y, y, cols // x, x).transpose(0, 2, 1, 3).reshape(-1, y * x)
                else:
                    at = at[: self._used(c)[0], : self._used(c)[1]].reshape(-1, 1)
                order.append((self.planes[c], at))
            _dc(order, h, low, data, [codes.get(t >> 4) for _, t in chosen])
            return
        c, t = chosen[0]
        rows, cols = self._used(c)
        whole = self.planes[c]
        part = whole if whole.shape[:2] == (rows, cols) else whole[:rows, :cols]
        blocks = part.reshape(-1, 64)
        (_ac_refine if h else _ac_first)(blocks, a, b, low, data, codes[0x10 | t & 15])
        if part is not whole:
            part[...] = blocks.reshape(rows, cols, 64)

    def _used(self, c: int) -> tuple[int, int]:
        """Block rows and columns of a component in a scan of its own."""
        x, y = self.factors[c]
        wide = -(-self.width * x // self.most[0])
        high = -(-self.height * y // self.most[1])
        return -(-high // 8), -(-wide // 8)

    def rgb(self) -> np.ndarray:
        """The picture at full resolution: (height, width, 3) bytes; chroma is repeated to the luma grid."""
        full = []
        for plane, quant, (x, y) in zip(self.planes, self.quant, self.factors, strict=True):
            rows, cols = plane.shape[:2]
            natural = np.empty((rows * cols, 64), np.float32)
            natural[:, ZIGZAG] = plane.reshape(-1, 64) * quant
            half = (natural.reshape(-1, 8) @ _COSINE).reshape(-1, 8, 8)  # over horizontal frequencies
            pixels = (half.transpose(0, 2, 1).reshape(-1, 8) @ _COSINE).reshape(rows, cols, 8, 8)
            pixels = pixels.transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)
            up_y, up_x = self.most[1] // y, self.most[0] // x
            if up_y > 1 or up_x > 1:
                pixels = np.repeat(np.repeat(pixels, up_y, 0), up_x, 1)
            full.append(pixels[: self.height, : self.width])
        if len(full) == 1:
            full *= 3
            full[1:] = [np.zeros_like(full[0])] * 2
        y, cb, cr = full[0] + 128, full[1], full[2]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, band in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            np.clip(np.rint(band, out=band), 0, 255, out=band)
            out[:, :, i] = band
        return out
