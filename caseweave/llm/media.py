"""Media columns as progressive JPEG.

Writing: a text's bytes, padded with zeros to whole 8x8 blocks, become DCT coefficients (byte plus two, so that no
coefficient vanishes in the first scans) of a YCbCr 4:2:0 image, and are written as spectral-selection and
successive-approximation scans with restart intervals. Nothing is quantised, so the bytes come back exactly.

Reading: every scan of every file in a batch is accumulated into coefficient arrays. Restart intervals are decoded
side by side, one symbol of each per numpy step. The coefficients are inverse-transformed, chroma is upsampled, and
full-resolution RGB tensors come out. The reader takes any 8-bit three-component or grey progressive file (restart
intervals or none, any Huffman tables); others raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

BLOCK, MCU_BLOCKS, RESTART = 64, 6, 4
#: Bytes of payload that are written and read back together; most MCUs in a row of an image (65,535 pixels).
SLICE_BYTES, MAX_WIDE = 1 << 20, 4095
#: Added to a byte to give its coefficient.
LIFT = 2

# Zigzag: place in the block (row * 8 + column) of the k-th coefficient, diagonal by diagonal.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])
_C = np.round(2048 * np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))
_LENGTH = np.array([int(x).bit_length() for x in range(1 << 12)])


def _table(first: list[int]) -> tuple[list[int], list[int]]:
    """(codes of each length 1 to 16, symbols): three 2-bit codes, three 4-bit ones, 12-bit ones for all other bytes."""
    rest = [s for s in range(255) if s not in first]
    counts = [0] * 16
    counts[1], counts[3], counts[11] = 3, 3, len(rest)
    return counts, first + rest


DC_TABLE = _table([5, 6, 4, 3, 2, 0])
AC_TABLE = _table([0x06, 0x05, 0x07, 0x00, 0x03, 0x04])


def _codes(table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and its length by symbol."""
    code, at, codes, sizes = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for size, n in enumerate(table[0], 1):
        for s in table[1][at : at + n]:
            codes[s], sizes[s] = code, size
            code += 1
        at, code = at + n, code << 1
    return codes, sizes


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix: length of its code << 8 | symbol; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for size, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | s
            code += 1
        at, code = at + n, code << 1
    return out


# ---------------------------------------------------------------- writing


def _or_into(words: np.ndarray, code: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
    """Sets ``size`` bits of each code at bit ``at`` (ascending) of big-endian 64-bit words."""
    some = size > 0
    code, size, at = code[some], size[some], at[some]
    if not len(code):
        return
    word, shift = at >> 6, (at & 63)
    over = np.maximum(shift + size - 64, 0)
    here = np.where(over > 0, code >> over.astype(np.uint64), code << np.maximum(64 - shift - size, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] |= np.bitwise_or.reduceat(here, first)
    cross = np.flatnonzero(over)
    words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)


def _entropy(code: np.ndarray, size: np.ndarray, interval: np.ndarray, scan: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each scan. Tokens lie in order; each interval (numbered from 0) is in one scan."""
    bits = np.bincount(interval, size).astype(np.int64)
    length = -(-bits // 8)
    start = np.cumsum(length) - length
    before = np.cumsum(size) - size
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    at = before + (start * 8 - before[first])[interval]
    words = np.zeros(int(length.sum()) // 8 + 2, np.uint64)
    _or_into(words, code, size, at)
    pad = length * 8 - bits
    _or_into(words, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1), pad, start * 8 + bits)
    data = words.byteswap().view(np.uint8)[: int(length.sum())]
    owner = scan[first]
    opens = np.concatenate([[True], owner[1:] != owner[:-1]])
    rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(opens, np.arange(len(owner)), 0))
    full, later = np.flatnonzero(data == 255), np.flatnonzero(~opens)
    where = np.concatenate([full + 1, np.repeat(start[later], 2)])
    what = np.concatenate([np.zeros(len(full), np.uint8), np.stack([np.full(len(later), 255), 0xD0 + (rank[later] - 1) % 8], 1).reshape(-1).astype(np.uint8)])
    order = np.argsort(where, kind="stable")
    out = np.insert(data, where[order], what[order])
    total = length + np.bincount(np.searchsorted(start + length, full, "right"), minlength=len(length)) + np.where(opens, 0, 2)
    ends = np.cumsum(np.add.reduceat(total, np.flatnonzero(opens)))
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@dataclass
class Layout:
    """Block rows of all images of a batch: image by image the Y, Cb and Cr blocks, each in raster order."""

    wide: np.ndarray
    high: np.ndarray
    base: np.ndarray = field(init=False)

    def __post_init__(self):
        mcus = self.wide * self.high
        self.base = np.cumsum(mcus * MCU_BLOCKS) - mcus * MCU_BLOCKS

    def interleaved(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each block in MCU order, and its image."""
        mcus = self.wide * self.high
        image = np.repeat(np.arange(len(mcus)), mcus * MCU_BLOCKS)
        b = np.arange(len(image)) - self.base[image]
        m, j = b // MCU_BLOCKS, b % MCU_BLOCKS
        w, n = self.wide[image], mcus[image]
        luma = (m // w * 2 + j // 2) * 2 * w + m % w * 2 + j % 2
        return self.base[image] + np.where(j < 4, luma, 4 * n + m + (j == 5) * n), image

    def planes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row of each plane, its number of rows, and each row's rank in its plane."""
        mcus = self.wide * self.high
        size = np.stack([4 * mcus, mcus, mcus], 1).reshape(-1)
        first = np.cumsum(size) - size
        return first, size, np.arange(size.sum()) - np.repeat(first, size)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _sos(parts: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *[x for p in parts for x in (p, 0)], ss, se, ah << 4 | al]))


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC4, bytes([0x00, *DC_TABLE[0], *DC_TABLE[1]]))
    + _segment(0xC4, bytes([0x10, *AC_TABLE[0], *AC_TABLE[1]]))
    + _segment(0xDD, RESTART.to_bytes(2, "big"))
)
BANDS = ((1, 5), (6, 63))


def write(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Progressive JPEG files that hold the texts, and the number of payload blocks of each.

    Scans: DC and two AC bands without their last bit, then that bit of DC and of AC. Blocks beyond the payload, which
    fill the last MCU, have no coefficients. A comment segment holds the number of payload blocks.
    """
    blocks = np.maximum(1, -(-np.fromiter(map(len, texts), np.int64, len(texts)) // BLOCK))
    mcus = -(-blocks // MCU_BLOCKS)
    high = -(-mcus // MAX_WIDE)
    layout = Layout(-(-mcus // high), high)
    rows, image = layout.interleaved()
    used = np.arange(len(rows)) - layout.base[image] < blocks[image]
    payload = np.frombuffer(b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True)), np.uint8)
    value = np.zeros((len(rows), BLOCK), np.int64)
    value[rows[used]] = payload.reshape(-1, BLOCK).astype(np.int64) + LIFT
    filled = np.zeros(len(rows), bool)
    filled[rows[used]] = True

    dc, dc_size = _codes(DC_TABLE)
    ac, ac_size = _codes(AC_TABLE)
    first, size, rank = layout.planes()
    plane = np.repeat(np.arange(len(first)), size)
    opens = rank % RESTART == 0
    interval = np.cumsum(opens) - 1
    mcu = (np.arange(len(rows)) - layout.base[image]) // MCU_BLOCKS
    turn = (mcu % RESTART == 0) & (np.arange(len(rows)) % MCU_BLOCKS == 0)
    dc_interval = np.cumsum(turn) - 1

    # DC: differences to the block before in the same plane, anew in each interval.
    low = value[rows, 0] >> 1
    six = low.reshape(-1, MCU_BLOCKS)
    fresh = turn.reshape(-1, MCU_BLOCKS)[:, 0]
    before = np.empty_like(six)
    before[:, 1:4] = six[:, :3]
    for j, k in ((0, 3), (4, 4), (5, 5)):
        before[:, j] = np.where(fresh, 0, np.concatenate([[0], six[:-1, k]]))
    diff = (six - before).reshape(-1)
    s = _LENGTH[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff).astype(np.uint64)
    parts = {(0, 1): _entropy((dc[s] << s.astype(np.uint64)) | extra, dc_size[s] + s, dc_interval, image)}
    parts[0, 0] = _entropy((value[rows, 0] & 1).astype(np.uint64), np.ones(len(rows), np.int64), dc_interval, image)
    for ss, se in BANDS:
        v = value[:, ss : se + 1] >> 1
        s = _LENGTH[v]
        code, bits = (ac[s] << s.astype(np.uint64)) | v.astype(np.uint64), ac_size[s] + s
        code[~filled], bits[~filled] = 0, 0
        code[~filled, 0], bits[~filled, 0] = ac[0], ac_size[0]
        n = code.shape[1]
        parts[ss, 1] = _entropy(code.reshape(-1), bits.reshape(-1), np.repeat(interval, n), np.repeat(plane, n))
    ones = (value & 1).astype(np.uint8)
    ones[:, 0] = 0
    code = np.stack([np.full(len(value), ac[0]), np.packbits(ones, axis=1).view(">u8").astype(np.uint64).reshape(-1)], 1)
    bits = np.stack([np.full(len(value), ac_size[0]), np.where(filled, 63, 0)], 1)
    parts[1, 0] = _entropy(code.reshape(-1), bits.reshape(-1), np.repeat(interval, 2), np.repeat(plane, 2))

    out = []
    for i, n in enumerate(blocks.tolist()):
        w, h = int(layout.wide[i]) * 16, int(layout.high[i]) * 16
        frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        scans = [_sos([1, 2, 3], 0, 0, 0, 1), parts[0, 1][i]]
        for ss, se in BANDS:
            for c in range(3):
                scans += [_sos([c + 1], ss, se, 0, 1), parts[ss, 1][3 * i + c]]
        scans += [_sos([1, 2, 3], 0, 0, 1, 0), parts[0, 0][i]]
        for c in range(3):
            scans += [_sos([c + 1], 1, 63, 1, 0), parts[1, 0][3 * i + c]]
        out.append(b"".join([b"\xff\xd8", _segment(0xFE, n.to_bytes(8, "big")), _TABLES, _segment(0xC2, frame), *scans, b"\xff\xd9"]))
    return out, blocks


# ---------------------------------------------------------------- reading


@dataclass
class Image:
    """A file's frame; ``planes`` has (horizontal, vertical sampling, blocks wide, blocks high, first row, quantisation)."""

    width: int
    height: int
    planes: list[tuple]
    note: bytes = b""


class _Bits:
    """Big-endian windows of 64 bits at every byte of the data without stuffed zeros."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(9, np.uint8)]).astype(np.uint64)
        self.windows = np.zeros(len(data) + 1, np.uint64)
        for k in range(8):
            self.windows = (self.windows << np.uint64(8)) | padded[k : k + len(self.windows)]
        self.last = len(self.windows) - 1

    def at(self, cursor: np.ndarray) -> np.ndarray:
        return self.windows[np.minimum(cursor >> 3, self.last)] << (cursor & 7).astype(np.uint64)


def _take(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits behind the first ``skip``, as integers; 0 where n is 0."""
    moved = window << skip.astype(np.uint64)
    return np.where(n > 0, moved >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)


@dataclass
class Lanes:
    """Restart intervals decoded side by side: bit cursor, tables, and slice of ``order`` (rows in scan order)."""

    cursor: np.ndarray
    table: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def _dc_first(coefs, bits, lanes: Lanes, order, plane, luts, tables, al) -> None:
    at, cursor = lanes.start.copy(), lanes.cursor.copy()
    pred = np.zeros((len(at), 4), np.int64)
    live = np.flatnonzero(at < lanes.stop)
    while len(live):
        p = plane[at[live]]
        w = bits.at(cursor[live])
        entry = luts[tables[lanes.table[live], p], (w >> np.uint64(48)).astype(np.int64)]
        size, s = entry >> 8, entry & 255
        pred[live, p] += _extend(_take(w, size, s), s)
        coefs[order[at[live]], 0] = pred[live, p] << al
        cursor[live] += size + s
        at[live] += 1
        live = live[at[live] < lanes.stop[live]]


def _dc_more(coefs, bits, lanes: Lanes, order, al) -> None:
    n = lanes.stop - lanes.start
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    bit = (bits.at(lanes.cursor[which] + k) >> np.uint64(63)).astype(np.int64)
    coefs[order[lanes.start[which] + k], 0] |= bit << al


def _ac_first(coefs, bits, lanes: Lanes, order, luts, ss, se, al) -> None:
    live = lanes.start < lanes.stop
    at, stop, cursor, table = (x[live].copy() for x in (lanes.start, lanes.stop, lanes.cursor, lanes.table))
    k = np.full(len(at), ss)
    flat = coefs.reshape(-1)
    while len(at):
        w = bits.at(cursor)
        entry = luts[table, (w >> np.uint64(48)).astype(np.int64)]
        size, r, s = entry >> 8, (entry >> 4) & 15, entry & 15
        if not size.all():
            raise ValueError("no such Huffman code")
        more = np.where((s == 0) & (r < 15), r, s)
        v = _take(w, size, more)
        put = s > 0
        k += r
        ok = put & (k <= se)
        flat[order[at[ok]] * BLOCK + k[ok]] = _extend(v[ok], s[ok]) << al
        k += 1
        cursor += size + more
        if put.all():
            over = k > se
            at += over
        else:
            ended = ~put & (r < 15)
            over = ended | (k > se)
            at += np.where(ended, (1 << r) + v, over)
        k[over] = ss
        if (done := over & (at >= stop)).any():
            at, stop, cursor, table, k = (x[~done] for x in (at, stop, cursor, table, k))


def _ac_more(coefs, bits, lanes: Lanes, order, luts, ss, se, al) -> None:
    """Refinement: a symbol a step, or all corrections of a block once its end was announced."""
    known = coefs != 0
    known[:, :ss] = False
    known[:, se + 1 :] = False
    upto = np.cumsum(known, axis=1, dtype=np.int16)
    live = lanes.start < lanes.stop
    at, stop, cursor, table = (x[live].copy() for x in (lanes.start, lanes.stop, lanes.cursor, lanes.table))
    k, run = np.full(len(at), ss), np.zeros(len(at), np.int64)
    spans, new = [], []
    while len(at):
        row = order[at]
        before = np.where(k > 0, upto[row, k - 1], 0)
        tail = run > 0
        w = bits.at(cursor)
        entry = luts[table, (w >> np.uint64(48)).astype(np.int64)]
        size, r, s = entry >> 8, (entry >> 4) & 15, entry & 15
        ends = ~tail & (s == 0) & (r < 15)
        value = _take(w, size, np.where(s == 0, r, 1))
        cursor += np.where(tail, 0, size + np.where(ends, r, s))
        run = np.where(ends, (1 << r) + value, run)
        # Corrections up to the end of the block: those announced before, or announced now.
        t = np.flatnonzero(tail | ends)
        spans.append((row[t], k[t], np.full(len(t), se + 1), cursor[t]))
        cursor[t] += upto[row[t], se] - before[t]
        run[t] -= 1
        k[t] = se + 1
        m = np.flatnonzero(~tail & ~ends)
        if len(m):
            zeros = np.cumsum(~known[row[m]] & (np.arange(BLOCK) >= k[m][:, None]) & (np.arange(BLOCK) <= se), axis=1)
            to = np.minimum(np.argmax(zeros > r[m][:, None], axis=1), se)
            spans.append((row[m], k[m], to, cursor[m]))
            cursor[m] += upto[row[m], to] - before[m]
            put = s[m] > 0
            new.append((row[m][put], to[put], np.where(value[m][put] > 0, 1, -1)))
            k[m] = to + 1
        over = k > se
        at += over
        k[over] = ss
        if (done := over & (at >= stop)).any():
            at, stop, cursor, table, k, run = (x[~done] for x in (at, stop, cursor, table, k, run))
    row, a, b, cursor = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 4
    for lo in range(0, len(row), 1 << 14):  # so many blocks at once
        r, x, y, c = row[lo : lo + (1 << 14)], a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)], cursor[lo : lo + (1 << 14)]
        i, j = np.nonzero(known[r] & (np.arange(BLOCK) >= x[:, None]) & (np.arange(BLOCK) < y[:, None]))
        base = np.where(x > 0, upto[r, np.maximum(x - 1, 0)], 0)
        bit = (bits.at(c[i] + upto[r[i], j] - 1 - base[i]) >> np.uint64(63)).astype(np.int64) << al
        old = coefs[r[i], j]
        coefs[r[i], j] = old + np.where(old > 0, bit, -bit)
    for r, to, sign in new:
        coefs[r, to] = sign << al


def _mcu_order(mcu: tuple[int, int], parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rows, counted from the image's first, and planes of the blocks of an interleaved scan."""
    grid = np.arange(mcu[0] * mcu[1])
    order, plane = [], []
    for i, x, y, w, first in parts:
        for j in range(x * y):
            order.append(first + (grid // mcu[0] * y + j // x) * w + grid % mcu[0] * x + j % x)
            plane.append(np.full(len(grid), i))
    return np.stack(order, 1).reshape(-1), np.stack(plane, 1).reshape(-1)


def _plane_order(own: tuple[int, int], w: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, counted from the plane's first, of the blocks of a scan of one plane."""
    grid = np.arange(own[0] * own[1])
    return grid // own[0] * w + grid % own[0], np.full(len(grid), i)


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The frames of progressive JPEG files, and the coefficients (zigzag order) of all their blocks, row by row."""
    whole = b"".join(files) + b"\xff\xd9"
    data = np.frombuffer(whole, np.uint8)
    full = np.flatnonzero(data[:-1] == 255)
    after = data[full + 1]
    stuffed = full[after == 0] + 1
    restart = full[(after >= 0xD0) & (after <= 0xD7)].tolist()
    hard = full[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))].tolist()
    keep = np.ones(len(data), bool)
    keep[stuffed] = False
    bits = _Bits(data[keep])
    luts, lut_of, images, rows = [np.zeros(1 << 16, np.int32)], {}, [], 0
    #: By step: (kind of scan) to lists of lanes; scans of other planes or files with the same step run side by side.
    steps: dict[tuple, list] = {}
    orders: dict[tuple, tuple] = {}
    base = 0
    for f in files:
        at, end, quant, tables, every, image, count = base + 2, base + len(f), {}, {}, 0, None, {}
        if f[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        note = b""
        while at < end:
            while whole[at] == 255 and whole[at + 1] == 255:
                at += 1
            marker = whole[at + 1]
            if marker == 0xD9:
                break
            n = int.from_bytes(whole[at + 2 : at + 4], "big")
            body = whole[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                note = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    key = body[1 : 17 + n]
                    if key not in lut_of:
                        lut_of[key] = len(luts)
                        luts.append(_lookup(key[:16], key[16:]))
                    tables[body[0]] = lut_of[key]
                    body = body[17 + n :]
            elif marker == 0xDD:
                every = int.from_bytes(body, "big")
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                if marker != 0xC2 or body[0] != 8 or body[5] not in (1, 3):
                    raise ValueError("not an 8-bit progressive file of one or three components")
                high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                most = max(p[1] for p in parts), max(p[2] for p in parts)
                mcu = -(-wide // (8 * most[0])), -(-high // (8 * most[1]))
                image = Image(wide, high, [])
                ids = {}
                for i, (name, x, y, q) in enumerate(parts):
                    ids[name] = i
                    # padded to whole MCUs; a scan of this plane alone covers (own wide, own high)
                    own = -(-(-(-wide * x // most[0])) // 8), -(-(-(-high * y // most[1])) // 8)
                    image.planes.append([x, y, mcu[0] * x, mcu[1] * y, rows, q, own])
                    rows += mcu[0] * x * mcu[1] * y
            elif marker == 0xDA:
                parts = [(ids[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
                ss, se, ah, al = *body[-3:-1], body[-1] >> 4, body[-1] & 15
                stop = hard[bisect_left(hard, at)]
                marks = restart[bisect_left(restart, at) : bisect_left(restart, stop)]
                together = len(parts) > 1 or (len(image.planes) == 1 and image.planes[0][:2] == [1, 1])
                if together:
                    key = (mcu, tuple((i, *image.planes[i][:3], image.planes[i][4] - image.planes[0][4]) for i, _ in parts))
                    order, plane = orders[key] if key in orders else orders.setdefault(key, _mcu_order(*key))
                    per, first = len(order) // (mcu[0] * mcu[1]), image.planes[0][4]
                else:
                    _, _, w, _, first, _, own = image.planes[parts[0][0]]
                    key = (own, w, parts[0][0])
                    order, plane = orders[key] if key in orders else orders.setdefault(key, _plane_order(*key))
                    per = 1
                own_tables = [0] * 4
                for i, t in parts:
                    own_tables[i] = tables.get(t >> 4, 0) if ss == 0 else tables.get(16 | t & 15, 0)
                step = max(count.get(i, 0) for i, _ in parts) + 1
                for i, _ in parts:
                    count[i] = step
                begins = [at]
                begins += [m + 2 for m in marks]
                steps.setdefault((step, ss, se, ah, al), []).append((begins, (every or len(order)) * per, order, plane, first, own_tables))
                at = stop
        if image is None:
            raise ValueError("no frame")
        for p in image.planes:
            p[5] = quant[p[5]]
        image.note = note
        images.append(image)
        base = end
    coefs = np.zeros((rows, BLOCK), np.int32)
    luts = np.stack(luts)
    for (_, ss, se, ah, al), scans in sorted(steps.items(), key=lambda x: x[0][0]):
        sizes = np.array([len(s[2]) for s in scans])
        offset = np.cumsum(sizes) - sizes
        n = np.array([len(s[0]) for s in scans])
        owner = np.repeat(np.arange(len(scans)), n)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        span = np.array([s[1] for s in scans])[owner]
        end = (offset + sizes)[owner]
        begin = np.fromiter((x for s in scans for x in s[0]), np.int64, len(owner))
        order = np.concatenate([s[2] for s in scans]) + np.repeat(np.array([s[4] for s in scans]), sizes)
        plane = np.concatenate([s[3] for s in scans])
        tables = np.array([s[5] for s in scans])
        lanes = Lanes((begin - np.searchsorted(stuffed, begin)) * 8, owner, np.minimum(offset[owner] + rank * span, end), np.minimum(offset[owner] + (rank + 1) * span, end))
        if ss == 0 and ah == 0:
            _dc_first(coefs, bits, lanes, order, plane, luts, tables, al)
        elif ss == 0:
            _dc_more(coefs, bits, lanes, order, al)
        else:
            lanes.table = tables.max(axis=1)[owner]
            (_ac_more if ah else _ac_first)(coefs, bits, lanes, order, luts, ss, se, al)
    return images, coefs


def tensors(images: list[Image], coefs: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB arrays (height, width, 3) of all images; integer arithmetic throughout, held in doubles."""
    plain = np.empty(coefs.shape, np.float64)
    for image in images:
        for _, _, w, h, first, q, _ in image.planes:
            plain[first : first + w * h, ZIGZAG] = coefs[first : first + w * h] * q
    half = (plain.reshape(-1, 8) @ _C).reshape(-1, 8, 8).transpose(0, 2, 1)
    samples = np.ascontiguousarray(half).reshape(-1, 8) @ _C
    samples = np.clip(np.floor((samples + 2**21) / 2**22) + 128, 0, 255).astype(np.int32).reshape(-1, 8, 8)  # [block, column, row]
    out = []
    for image in images:
        most = max(p[0] for p in image.planes), max(p[1] for p in image.planes)
        full = []
        for x, y, w, h, first, _, _ in image.planes:
            plane = samples[first : first + w * h].reshape(h, w, 8, 8).transpose(0, 3, 1, 2).reshape(h * 8, w * 8)
            if (x, y) != most:
                plane = plane[(np.arange(image.height) * y // most[1])[:, None], np.arange(image.width) * x // most[0]]
            full.append(plane[: image.height, : image.width])
        if len(full) == 1:
            rgb = np.repeat(full[0][:, :, None], 3, axis=2)
        else:
            luma, cb, cr = full[0], full[1] - 128, full[2] - 128
            rgb = np.stack([luma + ((91881 * cr + 32768) >> 16), luma - ((22554 * cb + 46802 * cr + 32768) >> 16), luma + ((116130 * cb + 32768) >> 16)], axis=2)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


def payloads(images: list[Image], coefs: np.ndarray) -> list[bytes]:
    """The bytes that write() stored."""
    layout = Layout(np.array([i.planes[1][2] for i in images]), np.array([i.planes[1][3] for i in images]))
    rows, _ = layout.interleaved()
    data = (coefs[rows] - LIFT).astype(np.uint8)
    return [data[b : b + int.from_bytes(i.note, "big")].tobytes() for b, i in zip(layout.base.tolist(), images, strict=True)]


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums and sums of squares of the full-resolution tensor."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{c}:{int(s)}:{int(q)}" for c, s, q in zip("rgb", flat.sum(axis=0), (flat * flat).sum(axis=0), strict=True))


# ---------------------------------------------------------------- columns


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for small in (s for batch in batches for s in bounded(batch, "_bytes", SLICE_BYTES)):
        media, _ = write([b or b"" for b in small.column("_bytes").to_pylist()])
        keep = [n for n in small.schema.names if n != "_bytes"]
        yield pa.RecordBatch.from_arrays([*[small.column(n) for n in keep], pa.array(media, pa.binary())], [*keep, "media"])


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its texts stored as column ``media`` (null: an empty text; an old column of the name is replaced)."""
    rows = df.drop("media").withColumn("_bytes", F.col(text_col).cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes")
    return rows.mapInArrow(_store, f"{schema}, media binary")


def _load(tensor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small in (s for batch in batches for s in bounded(batch, "media", 2 * SLICE_BYTES)):
            media = small.column("media").to_pylist()
            images, coefs = read(media)
            rgb = tensors(images, coefs)
            rest = [small.column(n) for n in small.schema.names if n != "media"]
            names = [n for n in small.schema.names if n != "media"]
            if tensor:
                more = [pa.array([i.width for i in images], pa.int32()), pa.array([i.height for i in images], pa.int32()), pa.array([x.tobytes() for x in rgb], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rest, *more], [*names, "width", "height", "rgb"])
                continue
            back = payloads(images, coefs)
            more = [
                pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([feature(x) for x in rgb]),
            ]
            yield pa.RecordBatch.from_arrays([*rest, *more], [*names, *DIGEST])

    return run


DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def load_tensors(df: DataFrame) -> DataFrame:
    """``df`` with ``width``, ``height`` and ``rgb`` (height x width x 3 bytes) in place of the files in ``media``."""
    rows = df.drop("width", "height", "rgb")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "media")
    return rows.mapInArrow(_load(True), f"{schema}, width int, height int, rgb binary" if schema else "width int, height int, rgb binary")


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with the columns DIGEST, computed from the files that store() wrote, in place of ``media``."""
    rows = df.drop(*DIGEST)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "media")
    return rows.mapInArrow(_load(False), f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
