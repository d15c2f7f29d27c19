"""A progressive JPEG codec in numpy, down to the coefficients (ITU-T T.81).

The reader accumulates spectral-selection and successive-approximation scans
into coefficient arrays, transforms them back, upsamples the chroma planes and
gives an RGB tensor. The writer stores given coefficients by the same kinds of
scans. Symbols are read at all bit positions at once and then followed from one
to the next, so Python takes one short step per symbol.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Place in the 8 x 8 block (row by row) of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: From a block's coefficients in zigzag order to its samples, row by row.
TO_PIXELS = np.kron(COSINES, COSINES)[ZIGZAG]
#: The same in whole numbers of 2^-20, which products and sums keep exactly in any order.
FIXED = np.rint(TO_PIXELS * 2.0**20)
_CHROMA = np.arange(-128, 128)
#: What a chroma sample adds to red, blue, and (in 2^-16, both together) to green.
_TO_RED, _TO_BLUE = ((k * _CHROMA + 32768 >> 16).astype(np.int16) for k in (91881, 116130))
_GREEN_CB, _GREEN_CR = (-22554 * _CHROMA + 32768).astype(np.int32), (-46802 * _CHROMA).astype(np.int32)
MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
LONGEST_RUN = 32767


def samples(coef: np.ndarray) -> np.ndarray:
    """The samples, 0 to 255, of blocks (rows) of coefficients in zigzag order."""
    return np.clip(np.floor(coef.astype(np.float64) @ FIXED * 2.0**-20 + 128.5), 0, 255).astype(np.uint8)


def colours(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Red, green and blue, as a last axis, of samples of the three planes."""
    out = np.empty((*y.shape, 3), np.uint8)
    light = y.astype(np.int16)
    np.clip(light + _TO_RED[cr], 0, 255, out=out[..., 0], casting="unsafe")
    np.clip(light + (_GREEN_CB[cb] + _GREEN_CR[cr] >> 16).astype(np.int16), 0, 255, out=out[..., 1], casting="unsafe")
    np.clip(light + _TO_BLUE[cb], 0, 255, out=out[..., 2], casting="unsafe")
    return out


_DC_EXTRA = np.arange(256, dtype=np.uint8) & 15
_AC_EXTRA = np.where(_DC_EXTRA > 0, _DC_EXTRA, np.where(np.arange(256) >> 4 < 15, np.arange(256) >> 4, 0)).astype(np.uint8)
_SHIFTS = np.arange(8, 0, -1, dtype=np.int32)


LONG = 1 << 20


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


class Huffman:
    """A canonical code from (counts of lengths 1 to 16, symbols)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.length, self.symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        self.codes, self.lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
        code = k = 0
        for n, count in enumerate(counts, 1):
            for s in symbols[k : k + count]:
                span = slice(code << (16 - n), (code + 1) << (16 - n))
                self.length[span], self.symbol[span] = n, s
                self.codes[s], self.lengths[s] = code, n
                code += 1
            k += count
            code <<= 1
        #: Bits that a symbol and its extra bits take, from the 16 bits it begins with; 255 if no symbol begins so.
        peek, size = np.arange(65536), self.symbol.astype(np.int64) & 15
        total = self.length + size
        bits = (peek >> np.maximum(16 - total, 0)) & ((1 << size) - 1)
        #: The value that follows a symbol where both fit into 16 bits, else LONG.
        self.value = np.where(total <= 16, np.where(size > 0, extended(bits, size), 0), LONG).astype(np.int32)
        self.dc_step, self.ac_step = (np.where(self.length > 0, self.length + extra[self.symbol], 255).astype(np.uint8) for extra in (_DC_EXTRA, _AC_EXTRA))

    @classmethod
    def of(cls, lengths: dict[int, int]) -> Huffman:
        """From each symbol's code length."""
        counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
        return cls(counts, bytes(sorted(lengths, key=lambda s: (lengths[s], s))))


@lru_cache(32)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


_SIZES = np.frexp(np.arange(1 << 15, dtype=np.float64))[1].astype(np.int64)


def category(values: np.ndarray) -> np.ndarray:
    """Bits that hold each value's magnitude."""
    return _SIZES[np.abs(values)]


def signed_bits(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << size) - 1, values)


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of up to 32 bits, one after the other, filled up with ones and stuffed."""
    other = lengths != 8
    head = int(other.argmax()) if other.any() else len(lengths)
    if head >= 64:  # whole bytes as they are
        return values[:head].astype(np.uint8).tobytes().replace(b"\xff", b"\xff\x00") + pack_bits(values[head:], lengths[head:])
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return b""
    starts = ends - lengths
    wide = values.astype(np.uint64) << (64 - (starts & 31) - lengths).astype(np.uint64)
    word = starts >> 5
    words = np.zeros((total >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.add.reduceat(wide >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    raw = bytearray(words.astype(">u4").tobytes()[: (total + 7) >> 3])
    if total & 7:
        raw[-1] |= 0xFF >> (total & 7)
    return bytes(raw).replace(b"\xff", b"\xff\x00")


class Bits:
    """Entropy-coded bytes, to be looked at from any bit."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 4, np.uint8)
        self.size = (len(raw) - 4) * 8
        wide = raw.astype(np.int32)
        self.window = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        self.raw = raw

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (at most 16) from each bit place."""
        return (self.window[at >> 3] >> (24 - (at & 7) - n)) & ((1 << n) - 1)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 16 bits from each bit place."""
        return (self.window[at >> 3] >> (8 - (at & 7))) & 0xFFFF

    def values(self, table: Huffman, peek: np.ndarray, where: np.ndarray) -> np.ndarray:
        """What the symbols that begin with ``peek``, at ``where``, carry."""
        found = table.value[peek]
        if len(at := np.flatnonzero(found == LONG)):
            size = table.symbol[peek[at]].astype(np.int64) & 15
            found[at] = extended(self.take(where[at] + table.length[peek[at]], size), size)
        return found

    def symbols(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(16 bits from each symbol's start, that place) up to the end; steps as in the symbols' table.

        Symbols that take equally many bits are followed at once, as long as such runs are long.
        """
        at, end, reach, found = 0, self.size, 256, []
        while at < end:
            n = int(steps[self.window[at >> 3] >> (8 - (at & 7)) & 0xFFFF])
            if n == 255:
                break
            run = np.arange(at, min(end, at + n * reach), n)
            other = steps[self.peek(run)] != n
            k = int(other.argmax()) if other[-1] or other.any() else len(run)
            found.append(run[:k])
            at, reach = at + n * k, reach * 4
            if k < 24 and at < end:
                found.append(self._one_by_one(at, steps))
                break
        where = np.concatenate(found) if found else np.zeros(0, np.int64)
        return self.peek(where), where

    def _one_by_one(self, at: int, steps: np.ndarray) -> np.ndarray:
        step = steps[(self.window[:-2, None] >> _SHIFTS) & 0xFFFF].tobytes()
        end, places = self.size, []
        add = places.append
        while at < end and (n := step[at]) != 255:
            add(at)
            at += n
        return np.array(places, np.int64)


class Component:
    """One plane: blocks in rows of the padded grid, coefficients in zigzag order."""

    def __init__(self, number: int, h: int, v: int, quant: int, width: int, height: int, mcu_w: int, mcu_h: int, h_max: int, v_max: int):
        self.number, self.h, self.v, self.quant = number, h, v, quant
        self.cols, self.rows = mcu_w * h, mcu_h * v
        self.coef = np.zeros((self.cols * self.rows, 64), np.int32)
        inner_w, inner_h = -(-(-(-width * h // h_max)) // 8), -(-(-(-height * v // v_max)) // 8)
        grid = np.arange(self.cols * self.rows).reshape(self.rows, self.cols)
        self.alone = grid[:inner_h, :inner_w].ravel()
        self.mcus = grid.reshape(mcu_h, v, mcu_w, h).transpose(0, 2, 1, 3).reshape(mcu_h * mcu_w, v * h)


def frame(width: int, height: int, parts: list[tuple[int, int, int, int]]) -> list[Component]:
    """Components from (number, h, v, quantisation table)."""
    h_max, v_max = max(p[1] for p in parts), max(p[2] for p in parts)
    mcu_w, mcu_h = -(-width // (8 * h_max)), -(-height // (8 * v_max))
    return [Component(*p, width, height, mcu_w, mcu_h, h_max, v_max) for p in parts]


def _eob_tokens(runs: np.ndarray, table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    k = np.frexp(runs.astype(np.float64))[1].astype(np.int64) - 1
    return (table.codes[k << 4] << k) | (runs - (1 << k)), table.lengths[k << 4] + k


def write_dc_first(parts: list[Component], low: int, table: Huffman) -> bytes:
    diffs = []
    for c in parts:
        value = c.coef[c.mcus.ravel(), 0] >> low
        diffs.append(np.diff(value, prepend=0).reshape(c.mcus.shape))
    diff = np.concatenate(diffs, axis=1).ravel().astype(np.int64)
    size = category(diff)
    return pack_bits((table.codes[size] << size) | signed_bits(diff, size), table.lengths[size] + size)


def write_dc_refine(parts: list[Component], low: int) -> bytes:
    bit = np.concatenate([(c.coef[c.mcus.ravel(), 0] >> low & 1).reshape(c.mcus.shape) for c in parts], axis=1).ravel()
    return pack_bits(bit, np.ones(len(bit), np.int64))


def write_ac_first(c: Component, start: int, stop: int, low: int, table: Huffman) -> bytes:
    band = c.coef[c.alone, start : stop + 1].astype(np.int64)
    width, n_blocks = band.shape[1], band.shape[0]
    value = (np.sign(band) * (np.abs(band) >> low)).ravel()
    at = np.flatnonzero(value)
    if len(at) and at[-1] + 1 == len(at):  # no zeros but after the last
        size = category(value[: len(at)])
        last = n_blocks - (len(at) - 1) // width - (len(at) % width == 0)
        values, lengths = (table.codes[size] << size) | signed_bits(value[: len(at)], size), table.lengths[size] + size
        if 0 < last <= LONGEST_RUN:
            v, n = _eob_tokens(np.array([last]), table)
            values, lengths = np.concatenate([values, v]), np.concatenate([lengths, n])
        if last <= LONGEST_RUN:
            return pack_bits(values, lengths)
    if not len(at):
        block = np.full(1, n_blocks)
        zrl, eob, size, own, code = np.zeros(1, np.int64), block, None, None, None
    else:
        block = at // width
        before = np.maximum(np.concatenate([[-1], at[:-1]]), block * width - 1)
        run = at - before - 1
        zrl, run = run >> 4, run & 15
        own = value[at]
        size = category(own)
        code = (run << 4) | size
        after = np.concatenate([block[1:], [n_blocks]])
        eob = after - block - (at % width == width - 1)
    lead = int(block[0]) if len(at) else 0
    n_eob = -(-eob // LONGEST_RUN)
    counts = zrl + (len(at) > 0) + n_eob
    ends = np.cumsum(counts)
    values, lengths = np.full(int(ends[-1]), table.codes[0xF0]), np.full(int(ends[-1]), table.lengths[0xF0])
    if len(at):
        place = ends - counts + zrl
        values[place] = (table.codes[code] << size) | signed_bits(own, size)
        lengths[place] = table.lengths[code] + size
    if n_eob.any():
        runs = np.full(int(n_eob.sum()), LONGEST_RUN)
        has = n_eob > 0
        runs[np.cumsum(n_eob[has]) - 1] = eob[has] - (n_eob[has] - 1) * LONGEST_RUN
        place = np.repeat(ends[has] - n_eob[has], n_eob[has]) + np.arange(len(runs)) - np.repeat(np.cumsum(n_eob[has]) - n_eob[has], n_eob[has])
        values[place], lengths[place] = _eob_tokens(runs, table)
    if lead:
        runs = np.full(-(-lead // LONGEST_RUN), LONGEST_RUN)
        runs[-1] = lead - (len(runs) - 1) * LONGEST_RUN
        v, n = _eob_tokens(runs, table)
        values, lengths = np.concatenate([v, values]), np.concatenate([n, lengths])
    return pack_bits(values, lengths)


def write_ac_refine(c: Component, start: int, stop: int, low: int, table: Huffman) -> bytes:
    band = c.coef[c.alone, start : stop + 1].astype(np.int64)
    width, total = band.shape[1], band.size
    size = np.abs(band).ravel() >> low
    known = size > 1
    rank = np.concatenate([[0], np.cumsum(known)])
    zeros = np.flatnonzero(~known)
    fixes = (size[known] & 1).astype(np.int64)
    values, lengths, q = [], [], 0

    def put(value: int, length: int, upto: int) -> None:
        """A token, and the correction bits of known coefficients from q on."""
        values.append(np.array([value]))
        lengths.append(np.array([length]))
        more = fixes[rank[q] : rank[upto]]
        values.append(more)
        lengths.append(np.ones(len(more), np.int64))

    def end_blocks(upto: int) -> None:
        nonlocal q
        while q < upto:
            run = min(-(-(upto - q) // width), LONGEST_RUN)
            v, n = _eob_tokens(np.array([run]), table)
            stop = (q // width + run) * width
            put(int(v[0]), int(n[0]), stop)
            q = stop

    for t in np.flatnonzero(size == 1).tolist():
        if q // width < t // width:
            end_blocks(t // width * width)
        gap = int((t - rank[t]) - (q - rank[q]))
        while gap > 15:
            u = int(zeros[q - rank[q] + 15])
            put(int(table.codes[0xF0]), int(table.lengths[0xF0]), u)
            q, gap = u + 1, gap - 16
        sign = int(band.flat[t] > 0)
        put(int(table.codes[gap << 4 | 1]) << 1 | sign, int(table.lengths[gap << 4 | 1]) + 1, t)
        q = t + 1
    end_blocks(total)
    return pack_bits(np.concatenate(values), np.concatenate(lengths)) if values else b""


def read_dc_first(parts: list[Component], mcus: slice, low: int, tables: list[Huffman], bits: Bits) -> None:
    shape = [c.mcus[mcus] for c in parts]
    per = [s.shape[1] for s in shape]
    n = sum(s.size for s in shape)
    if all(t is tables[0] for t in tables):
        peek, where = bits.symbols(tables[0].dc_step)
        diff = bits.values(tables[0], peek[:n], where[:n])
    else:
        of = np.tile(np.repeat(np.arange(len(parts)), per), len(shape[0])).tolist()
        at, diff = 0, np.zeros(n, np.int64)
        for i, k in enumerate(of):
            peek = bits.peek(np.array([at]))
            diff[i] = bits.values(tables[k], peek, np.array([at]))[0]
            at += int(tables[k].dc_step[peek[0]])
    diff = diff.reshape(len(shape[0]), -1)
    for c, s, k in zip(parts, shape, np.cumsum([0, *per[:-1]])):
        c.coef[s.ravel(), 0] = np.cumsum(diff[:, k : k + s.shape[1]].ravel()) << low


def read_dc_refine(parts: list[Component], mcus: slice, low: int, bits: Bits) -> None:
    shape = [c.mcus[mcus] for c in parts]
    n = sum(s.size for s in shape)
    bit = np.unpackbits(bits.raw, count=n).astype(np.int32).reshape(len(shape[0]), -1)
    k = 0
    for c, s in zip(parts, shape):
        c.coef[s.ravel(), 0] |= bit[:, k : k + s.shape[1]].ravel() << low
        k += s.shape[1]


def read_ac_first(c: Component, blocks: np.ndarray, start: int, stop: int, low: int, table: Huffman, bits: Bits) -> None:
    width = stop - start + 1
    peek, where = bits.symbols(table.ac_step)
    symbol = table.symbol[peek].astype(np.int64)
    run, size = symbol >> 4, symbol & 15
    step = run + 1
    at = np.cumsum(step) - 1
    ends = np.flatnonzero((size == 0) & (run < 15))
    if len(ends):
        runs = (1 << run[ends]) + bits.take(where[ends] + table.length[peek[ends]], run[ends])
        shift, first = np.zeros(len(symbol), np.int64), 0
        base, total = 0, np.concatenate([[0], np.cumsum(step)])
        for e, n in zip(ends.tolist(), runs.tolist()):
            shift[first:e] = base - total[first]
            now = base + int(total[e] - total[first])
            base, first = (now // width + n) * width, e + 1
        shift[first:] = base - total[first]
        at = at + shift
    own = np.flatnonzero((size > 0) & (at < len(blocks) * width))
    c.coef[blocks[at[own] // width], start + at[own] % width] = bits.values(table, peek[own], where[own]) * (1 << low)


def read_ac_refine(c: Component, blocks: np.ndarray, start: int, stop: int, low: int, table: Huffman, bits: Bits) -> None:
    band = c.coef[blocks, start : stop + 1]
    width, total = band.shape[1], band.size
    flat = band.ravel()
    known = flat != 0
    rank = np.concatenate([[0], np.cumsum(known)])
    zeros = np.flatnonzero(~known)
    bit = np.unpackbits(bits.raw)
    fixes, new, q, p = [], [], 0, 0
    while q < total:
        peek = int(bits.window[p >> 3] >> (8 - (p & 7)) & 0xFFFF)
        symbol, p = int(table.symbol[peek]), p + int(table.length[peek])
        run, size = symbol >> 4, symbol & 15
        if size == 0 and run < 15:
            n = (1 << run) + int(bits.take(np.array([p]), np.array([run]))[0])
            p += run
            upto = following = min((q // width + n) * width, total)
        else:
            sign = int(bit[p])
            p += size
            upto = int(zeros[q - rank[q] + run])
            following = upto + 1
            if size:
                new.append((upto, 1 if sign else -1))
        count = int(rank[upto] - rank[q])
        fixes.append(bit[p : p + count])
        p, q = p + count, following
    wrong = np.flatnonzero(known)[np.concatenate(fixes).astype(bool)] if fixes else np.zeros(0, np.int64)
    flat[wrong] += np.sign(flat[wrong]) << low
    for t, sign in new:
        flat[t] = sign * (1 << low)
    c.coef[blocks, start : stop + 1] = flat.reshape(band.shape)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scan_header(numbers: list[int], table: int, start: int, stop: int, high: int, low: int) -> bytes:
    """The header of a scan of the components of these numbers."""
    return segment(0xDA, bytes([len(numbers)]) + b"".join(bytes([c, table]) for c in numbers) + bytes([start, stop, high << 4 | low]))


def write(width: int, height: int, parts: list[Component], script: list[tuple[list[int], int, int, int, int]], tables: dict[str, Huffman], comment: bytes = b"") -> bytes:
    """A progressive JPEG of the components' coefficients; script: (components, start, stop, high, low) of each scan; tables: dc, ac and refine."""
    out = [b"\xff\xd8", segment(0xFE, comment) if comment else b"", segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([c.number, c.h << 4 | c.v, 0]) for c in parts)))
    for kind, name in ((0x00, "dc"), (0x10, "ac"), (0x11, "refine")):
        out.append(segment(0xC4, bytes([kind]) + tables[name].counts + tables[name].symbols))
    for own, start, stop, high, low in script:
        chosen = [parts[k] for k in own]
        table = 1 if high and start else 0
        out.append(scan_header([c.number for c in chosen], table, start, stop, high, low))
        if start == 0:
            out.append(write_dc_refine(chosen, low) if high else write_dc_first(chosen, low, tables["dc"]))
        elif high:
            out.append(write_ac_refine(chosen[0], start, stop, low, tables["refine"]))
        else:
            out.append(write_ac_first(chosen[0], start, stop, low, tables["ac"]))
    return b"".join([*out, b"\xff\xd9"])


class Image:
    """A progressive JPEG read back: width, height, parts (components), comment, quantisation tables."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comment, self.quant, tables = b"", {}, {}
        at, interval = 2, 0
        while True:
            marker, length = data[at + 1], 0
            if marker == 0xD9:
                break
            (length,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[n + 1 :]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = frame(self.width, self.height, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                end = MARKER.search(data, at).start()
                self._scan(body, data[at:end], tables, interval)
                at = end

    def _scan(self, head: bytes, data: bytes, tables: dict[int, Huffman], interval: int) -> None:
        n = head[0]
        by_number = {c.number: c for c in self.parts}
        parts, ids = [by_number[head[1 + 2 * k]] for k in range(n)], [head[2 + 2 * k] for k in range(n)]
        start, stop, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if interval else [data]
        for k, piece in enumerate(pieces):
            bits = Bits(piece)
            part = slice(k * interval, (k + 1) * interval) if interval else slice(None)
            if start == 0:
                if n == 1:  # a scan of one component goes over its own blocks
                    parts[0].mcus, kept = parts[0].alone[:, None], parts[0].mcus
                if high:
                    read_dc_refine(parts, part, low, bits)
                else:
                    read_dc_first(parts, part, low, [tables[i >> 4] for i in ids], bits)
                if n == 1:
                    parts[0].mcus = kept
            else:
                read = read_ac_refine if high else read_ac_first
                read(parts[0], parts[0].alone[part], start, stop, low, tables[0x10 | ids[0] & 15], bits)

    def planes(self) -> list[np.ndarray]:
        """Each component's samples, 0 to 255, on its own grid."""
        out = []
        for c in self.parts:
            pixels = samples(c.coef * self.quant[c.quant])
            out.append(pixels.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor (height, width, 3) of unsigned bytes."""
        h_max, v_max = max(c.h for c in self.parts), max(c.v for c in self.parts)
        full = [p.repeat(v_max // c.v, axis=0).repeat(h_max // c.h, axis=1)[: self.height, : self.width] for c, p in zip(self.parts, self.planes())]
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, axis=2)
        return colours(*full)
