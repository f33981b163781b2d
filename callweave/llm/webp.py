"""Lossless WebP: a reader and a writer of whole streams.

Both know prefix codes (simple and normal), back-references, the colour cache, groups of
codes and the predictor, cross-colour, subtract-green and palette transforms. A text is an
image of 192 samples a row, one byte in the green channel of each pixel: the writer gives
it a palette (with several pixels in one where 16 colours or fewer do), back-references
and prefix codes by count, so that each text is decoded by these.

Defined results: null and empty texts are a payload of 192 blanks; texts of any length are
stored whole, beyond one image's height in further images; equal texts give equal bytes
(repeated rows give their rows; of tied counts the smaller symbol comes first); an empty
table gives no rows; rows without an id keep a null one; only id and text are read,
whatever the other columns' names; broken streams raise ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ROW, SIDE = 192, 16384

# Fixed values of the format: order of the code length codes, alphabet sizes, near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (280, 256, 256, 256, 40)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a >> 3) + 5], "little") >> (a & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("stream ends early")
        return v

    def span(self, a: int, n: int) -> int:
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


@functools.cache
def _mirror(width: int) -> np.ndarray:
    """The numbers of ``width`` bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, lengths, share of all codes of the longest length) of a prefix code's used symbols, shortest first."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    sizes = lengths[symbols]
    return symbols, sizes, 1 << sizes[-1] - sizes


class Code:
    """Prefix code as a table over the longest code's bits: symbols and the bits of their codes."""

    def __init__(self, lengths: list[int]):
        most = max(lengths)
        if not most:
            raise ValueError("empty prefix code")
        if lengths.count(0) == len(lengths) - 1:
            self.__dict__ = Code.of(lengths.index(most)).__dict__
            return
        symbols, sizes, share = _in_order(np.array(lengths))
        self.width = most
        if share.sum() != 1 << most:
            raise ValueError("prefix code is not complete")
        at = _mirror(most)
        self.symbols, self.sizes = symbols.repeat(share)[at], sizes.repeat(share)[at]

    @classmethod
    def of(cls, symbol: int) -> Code:
        """The code of a single symbol, which takes no bits."""
        out = cls.__new__(cls)
        out.width, out.symbols, out.sizes = 0, np.array([symbol]), np.zeros(1, np.int64)
        return out

    @functools.cached_property
    def table(self) -> list[tuple[int, int]]:
        return list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        s, n = self.table[bits.peek(self.width)]
        bits.at += n
        return s


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        for s in [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else []):
            lengths[s] = 1
        return Code(lengths) if two else Code.of(s)
    first = [0] * 19
    n = 4 + bits.take(4)
    threes = bits.span(bits.at, 3 * n)
    bits.at += 3 * n
    for i, s in enumerate(LENGTH_ORDER[:n]):
        first[s] = threes >> 3 * i & 7
    code = Code(first)
    left = size
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    data, table, mask, before = bits.data, code.table, (1 << code.width) - 1, 8
    at, acc, have = (bits.at >> 3) + 1, bits.peek(8 - (bits.at & 7)), 8 - (bits.at & 7)
    lengths = []
    while len(lengths) < size and left:
        left -= 1
        if have < 16:
            acc |= int.from_bytes(data[at : at + 8], "little") << have
            have += 64
            at += 8
            if at > len(data) + 16:
                raise ValueError("stream ends early")
        s, k = table[acc & mask]
        acc >>= k
        have -= k
        if s < 16:
            lengths.append(s)
            before = s or before
            continue
        k, n = ((2, 3), (3, 3), (7, 11))[s - 16]
        n += acc & ((1 << k) - 1)
        acc >>= k
        have -= k
        lengths += [before if s == 16 else 0] * n
    bits.at = 8 * at - have
    if len(lengths) > size:
        raise ValueError("code lengths overrun")
    return Code(lengths + [0] * (size - len(lengths)))


def _pixels(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """ARGB values of one coded image."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, shift, which = 1, 0, None
    if main and bits.take(1):
        shift = bits.take(3) + 2
        gw = -(-w >> shift)
        which = (_pixels(bits, gw, -(-h >> shift), False) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n + (cache_size if i == 0 else 0)) for i, n in enumerate(ALPHABETS)] for _ in range(groups)]
    n, data, end = w * h, bits.data, len(bits.data)
    out: list[int] = []
    cache, kept = [0] * cache_size, 0
    at = bits.at >> 3  # bytes taken into ``acc``, which holds ``have`` bits yet
    acc, have = data[at] >> (bits.at & 7) if at < end else 0, 8 - (bits.at & 7)
    at += 1
    cs = None
    if which is None and n > 256 and not cache_size and not any(c.width for c in codes[0][1:4]) and codes[0][0].width:
        return _one_channel(bits, codes[0], w, n)
    while (done := len(out)) < n:
        if which is not None or cs is None:
            cs = codes[which[(done // w >> shift) * gw + (done % w >> shift)] if which is not None else 0]
            (green, red, blue, alpha, far), plain = cs, 0
            table, mask, width = green.table, (1 << green.width) - 1, green.width or 1
            flat = not red.width | blue.width | alpha.width
            if flat:
                plain = alpha.table[0][0] << 24 | red.table[0][0] << 16 | blue.table[0][0]
        if have < 64:
            if at > end + 8:
                raise ValueError("stream ends early")
            acc |= int.from_bytes(data[at : at + 32], "little") << have
            have += 256
            at += 32
        s, k = table[acc & mask]
        acc >>= k
        have -= k
        if s < 256:
            if flat:
                out.append(plain | s << 8)
                continue
            value = s << 8
            for code, place in ((red, 16), (blue, 0), (alpha, 24)):
                s, k = code.table[acc & ((1 << code.width) - 1)]
                acc >>= k
                have -= k
                value |= s << place
            out.append(value)
        elif s < 280:
            k = 0 if s < 260 else (s - 258) >> 1
            length = s - 255 if s < 260 else ((2 + (s & 1)) << k) + (acc & ((1 << k) - 1)) + 1
            acc >>= k
            s, used = far.table[acc & ((1 << far.width) - 1)]
            acc >>= used
            have -= k + used
            k = 0 if s < 4 else (s - 2) >> 1
            d = s + 1 if s < 4 else ((2 + (s & 1)) << k) + (acc & ((1 << k) - 1)) + 1
            acc >>= k
            have -= k
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * w)
            if d > done or done + length > n:
                raise ValueError("back-reference leaves the image")
            out += out[done - d : done - d + length] if d >= length else (out[done - d :] * (length // d + 1))[:length]
        else:
            while kept < done:
                cache[(0x1E35A7BD * out[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[kept]
                kept += 1
            out.append(cache[s - 280])
    bits.at = 8 * at - have
    if bits.at > 8 * end:
        raise ValueError("stream ends early")
    return np.array(out, np.uint32)


def _one_channel(bits: Bits, codes: list[Code], w: int, n: int) -> np.ndarray:
    """Pixels that differ in green only: what a code at any bit of the stream would mean is looked up for all bits at once, in
    stretches, and literals and references are picked along the chain of their ends."""
    green, far, data = codes[0], codes[4], bits.data
    out, at, reach, end = bytearray(), bits.at, 1 << 15, 8 * len(data)
    while len(out) < n:
        base = at >> 3 << 3  # a stretch of the stream, from a whole byte
        raw = data[base >> 3 : (base + reach >> 3) + 16]
        if at >= end:
            raise ValueError("stream ends early")
        limit = min(8 * len(raw), reach)  # a stretch's last code may end beyond it
        wide = np.ndarray((len(raw) + 8,), "<u8", raw + bytes(16), strides=(1,))
        window = np.empty((limit >> 3, 8), np.intp)
        for i in range(8):
            np.right_shift(wide[: limit >> 3], np.uint64(i), out=window[:, i], casting="unsafe")
        window &= (1 << green.width) - 1
        means = green.symbols.take(window.ravel())
        one = np.arange(limit + 16)  # ends of what starts at a bit; beyond the stretch they stay
        one[:limit] += green.sizes.take(window.ravel())
        refs = np.flatnonzero(means > 255)
        s, q = means[refs] - 256, one[refs]
        length, q = _unprefix(wide, s, q)
        d = (wide[q >> 3] >> (q & 7).astype(np.uint64)).astype(np.int64) & (1 << far.width) - 1
        d, q = _unprefix(wide, far.symbols[d], q + far.sizes[d])
        one[refs] = np.minimum(q, limit + 15)  # the true ends are ``q``
        two = one.take(one)
        four = two.take(two)
        leaps, anchors, p = memoryview(four.take(four)), [], at - base
        while p < limit:
            anchors.append(p)
            p = leaps[p]
        run = np.empty((len(anchors), 8), np.intp)
        run[:, 0] = anchors
        run[:, 4] = four.take(run[:, 0])
        run[:, 2::4] = two.take(run[:, ::4])
        run[:, 1::2] = one.take(run[:, ::2])
        run = run[run < limit]
        symbol = means.take(run)
        copies = np.flatnonzero(symbol > 255)
        which = np.searchsorted(refs, run[copies])
        literal, room, done, copied = np.delete(symbol, copies).astype(np.uint8).tobytes(), n - len(out), 0, 0
        ends = one.take(run)
        ends[copies] = q[which]
        for i, (k, more, back) in enumerate(zip(copies.tolist(), length[which].tolist(), d[which].tolist(), strict=True)):
            if k - i + copied >= room:  # the image ended before
                break
            out += literal[done : k - i]
            done, copied = k - i, copied + more
            if back > 120:
                back -= 120
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * w)
            if back > len(out) or done + copied > room:
                raise ValueError("back-reference leaves the image")
            out += out[-back : len(out) - back + more] if back >= more else (out[-back:] * (more // back + 1))[:more]
        else:
            i = len(copies)
        taken = min(room - copied, len(literal)) + i  # literals and references of the image
        out += literal[done : room - copied]
        at = base + int(ends[taken - 1])
    bits.at = at
    if at > end:
        raise ValueError("stream ends early")
    plain = codes[3].table[0][0] << 24 | codes[1].table[0][0] << 16 | codes[2].table[0][0]
    return np.uint32(plain) | np.frombuffer(bytes(out), np.uint8).astype(np.uint32) << np.uint32(8)


def _unprefix(wide: np.ndarray, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances whose prefix symbols are ``s`` and whose extra bits start at ``at``, and where these end."""
    k = np.maximum(s - 2, 0) >> 1
    extra = (wide[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & (1 << k) - 1
    return np.where(s < 4, s, (2 + (s & 1) << k) + extra) + 1, at + k


def _bytes(v: int) -> tuple[int, int, int, int]:
    return v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255


def _guess(mode: int, left: int, top: int, corner: int, right: int) -> tuple:
    ls, ts, cs, rs = _bytes(left), _bytes(top), _bytes(corner), _bytes(right)

    def mean(p, q):
        return tuple((a + b) >> 1 for a, b in zip(p, q, strict=True))

    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(ts, cs, strict=True))
        pt = sum(abs(a - c) for a, c in zip(ls, cs, strict=True))
        return ls if pl < pt else ts
    if mode == 12:
        return tuple(min(255, max(0, a + t - c)) for a, t, c in zip(ls, ts, cs, strict=True))
    if mode == 13:
        return tuple(min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(ls, ts), cs, strict=True))
    plain = {1: ls, 2: ts, 3: rs, 4: cs}
    if mode in plain:
        return plain[mode]
    pairs = {6: (ls, cs), 7: (ls, ts), 8: (cs, ts), 9: (ts, rs)}
    if mode in pairs:
        return mean(*pairs[mode])
    if mode == 5:
        return mean(mean(ls, rs), ts)
    if mode == 10:
        return mean(mean(ls, cs), mean(ts, rs))
    return 255, 0, 0, 0


def _unpredict(px: np.ndarray, w: int, h: int, bits: int, modes: np.ndarray) -> np.ndarray:
    v, mw = px.tolist(), -(-w >> bits)
    mode = (modes >> 8 & 255).tolist()
    for at in range(w * h):
        x, y = at % w, at // w
        if y == 0:
            guess = (255, 0, 0, 0) if x == 0 else _bytes(v[at - 1])
        elif x == 0:
            guess = _bytes(v[at - w])
        else:
            guess = _guess(mode[(y >> bits) * mw + (x >> bits)], v[at - 1], v[at - w], v[at - w - 1], v[at - w + 1])
        a, r, g, b = ((p + q) & 255 for p, q in zip(_bytes(v[at]), guess, strict=True))
        v[at] = a << 24 | r << 16 | g << 8 | b
    return np.array(v, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).astype(np.int8).astype(np.int32)


def _uncross(px: np.ndarray, w: int, h: int, bits: int, factors: np.ndarray) -> np.ndarray:
    f = factors[(np.arange(h) >> bits)[:, None] * -(-w >> bits) + (np.arange(w) >> bits)[None, :]].ravel()
    g = _signed(px >> 8)
    r = (px >> 16).astype(np.int64) + (_signed(f) * g >> 5) & 255
    b = px.astype(np.int64) + (_signed(f >> 8) * g >> 5) + (_signed(f >> 16) * _signed(r) >> 5) & 255
    return (px & 0xFF00FF00) | (r.astype(np.uint32) << 16) | b.astype(np.uint32)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _decode_one(data: bytes) -> np.ndarray:
    if data[:1] != b"\x2f":
        raise ValueError("not a lossless stream")
    bits = Bits(data)
    bits.take(8)
    w, h = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    undo, width, seen = [], w, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            size = bits.take(3) + 2
            undo.append((kind, width, size, _pixels(bits, -(-width >> size), -(-h >> size), False)))
        elif kind == 2:
            undo.append((kind, width, 0, None))
        else:
            count = bits.take(8) + 1
            colours = _pixels(bits, count, 1, False)
            colours = np.cumsum(colours.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((kind, width, pack, colours))
            width = -(-width >> pack)
    px = _pixels(bits, width, h, True)
    for kind, tw, arg, image in reversed(undo):
        if kind == 0:
            px = _unpredict(px, tw, h, arg, image)
        elif kind == 1:
            px = _uncross(px, tw, h, arg, image)
        elif kind == 2:
            g = px >> 8 & 255
            px = _add(px, g << 16 | g)
        else:
            x = np.arange(tw)
            row = px.reshape(h, -1)[:, x >> arg] >> 8 & 255
            index = (row >> (x & ((1 << arg) - 1)) * (8 >> arg) & ((1 << (8 >> arg)) - 1)).ravel()
            px = np.append(image, np.zeros(256, np.uint32))[index]
    return px.astype("<u4").view(np.uint8).reshape(h, w, 4)[..., [2, 1, 0, 3]]


def decode(data: bytes) -> list[np.ndarray]:
    """RGBA arrays (height, width, 4) of one or more lossless images in a row."""
    out, at = [], 0
    while at < len(data):
        mark, size, kind = struct.unpack_from("<4sI8s", data, at)
        if mark != b"RIFF" or kind != b"WEBPVP8L":
            raise ValueError("not a lossless WebP")
        (n,) = struct.unpack_from("<I", data, at + 16)
        if n + 12 > size + 1 or at + 20 + n > len(data):
            raise ValueError("lengths do not fit")
        out.append(_decode_one(data[at + 20 : at + 20 + n]))
        at += 8 + size
    return out


#: A run of (value, bits) pairs.
Fields = list[tuple[int, int]]


def _lengths(counts: list[int], most: int) -> list[int]:
    """Lengths, ``most`` at the most, of a prefix code by count; a single symbol has length 1."""
    out = [0] * len(counts)
    used = [(c, s) for s, c in enumerate(counts) if c]
    if len(used) < 2:
        for _, s in used:
            out[s] = 1
        return out
    while True:
        used.sort()
        n = len(used)
        weight, parent, leaf, inner = [c for c, _ in used], [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):  # the two lightest of the sorted leaves and of the nodes made so far, which ascend
            both = 0
            for _ in range(2):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, inner = inner, inner + 1
                both += weight[at]
                parent[at] = new
            weight.append(both)
        depth = [0] * (2 * n - 1)
        for x in range(2 * n - 3, -1, -1):
            depth[x] = depth[parent[x]] + 1
        if max(depth) <= most:
            for (_, symbol), d in zip(used, depth, strict=False):
                out[symbol] = d
            return out
        used = [((c + 1) // 2 if c > 1 else 1, symbol) for c, symbol in used]


def _codes(lengths: list[int]) -> np.ndarray:
    """Code of each symbol, first bit lowest; a single symbol takes no bits."""
    out = np.zeros(len(lengths), np.int64)
    symbols, sizes, share = _in_order(np.array(lengths))
    if len(symbols) > 1:
        out[symbols] = _mirror(int(sizes[-1]))[np.cumsum(share) - share]
    return out


def _few_fields(used: list[int]) -> Fields:
    """The simple form of a code of one or two symbols."""
    wide = used[0] > 1
    return [(1, 1), (len(used) - 1, 1), (int(wide), 1), (used[0], 8 if wide else 1), *[(s, 8) for s in used[1:]]]


def _code_fields(lengths: list[int]) -> Fields:
    used = [s for s, n in enumerate(lengths) if n] or [0]
    if len(used) <= 2 and used[-1] < 256:
        return _few_fields(used)
    runs, before = [], 8
    for n, same in groupby(lengths):
        run = len(list(same))
        if n and n != before:
            runs.append((n, 0, 0))
            before, run = n, run - 1
        while run >= 3:
            k = min(run, 138 if not n else 6)
            runs.append((16, k - 3, 2) if n else (18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
            run -= k
        runs += [(n, 0, 0)] * run
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    first = _lengths(counts, 7)
    code, single = _codes(first), sum(map(bool, first)) == 1
    n = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if first[s]))
    out = [(0, 1), (n - 4, 4), *[(first[s], 3) for s in LENGTH_ORDER[:n]], (0, 1)]
    code = code.tolist()
    for s, extra, k in runs:
        out.append((code[s], 0 if single else first[s]))
        if k:
            out.append((extra, k))
    return out


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths and distances."""
    x = v - 1
    high = np.frexp(np.maximum(x, 1).astype(float))[1] - 1
    k = np.maximum(high - 1, 0)
    small = x < 4
    return np.where(small, x, 2 * high + (x >> k & 1)), np.where(small, 0, x & ((1 << k) - 1)), np.where(small, 0, k)


@functools.lru_cache(maxsize=64)
def _near(w: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * w), i)
    return out


#: Bits of a place in an image of ``ROW`` times ``SIDE`` samples, and more; larger images are no texts and find fewer references.
_PLACE = np.uint64(28)


def _matches(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, none of which overlap: at each place the last earlier like run."""
    if int(px.max(initial=0)) < 256:  # exact: a run of ``g`` values in 64 bits
        g, m = 8, len(px) - 7
        key = np.ndarray((max(0, m),), "<u8", px.astype(np.uint8).tobytes() + bytes(8), strides=(1,))
    else:
        g, m, v = 2, len(px) - 1, px.astype(np.uint64)
        key = v[:m] | v[1:] << np.uint64(32)
    if m < 2:
        return []
    # Like runs come together, in their order, when a hash above the place is sorted; unlike ones of one hash are told apart.
    order = np.sort(key * np.uint64(0x9E3779B97F4A7C15) >> _PLACE << _PLACE | np.arange(m, dtype=np.uint64))
    order = (order & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    same = key[order[1:]] == key[order[:-1]]
    last = np.full(m, -1)
    last[order[1:][same]] = order[:-1][same]
    goes_on = np.append((last[1:] == last[:-1] + 1) & (last[:-1] >= 0), False)
    breaks = np.flatnonzero(~goes_on)
    starts = np.flatnonzero(last >= 0)
    starts = starts[starts - last[starts] < 1_000_000]
    size = breaks[np.searchsorted(breaks, starts)] - starts + g
    places, out, at, k = starts.tolist(), [], 0, 0
    far, size = (starts - last[starts]).tolist(), np.minimum(size, 4096).tolist()
    while (k := bisect_left(places, at, k)) < len(places):
        out.append((places[k], size[k], far[k]))
        at = places[k] + size[k]
    return out


def _image(px: np.ndarray, w: int, main: bool, cache_bits: int = 0, split: int = 0) -> list:
    """Fields (a list, or arrays of values and bits) of one coded image; ``split`` gives blocks in turn one of two groups of codes."""
    n = len(px)
    keys = px >> 8 & 255 if not ((px ^ px[0]) & 0xFFFF00FF).any() else px
    found = _matches(keys) if n > 256 else []
    start, size, far = np.array(found, np.int64).reshape(-1, 3).T
    kind = np.zeros(n + 1, np.int64)  # 1 where a reference starts, -1 behind it
    kind[start] = 1
    kind[start + size] -= 1
    place = np.flatnonzero((np.cumsum(kind[:n]) == 0) | (np.bincount(start, minlength=n) > 0))
    copy = np.zeros(n, bool)
    copy[start] = True
    copy = copy[place]
    v = px[place]
    first = (v >> 8 & 255).astype(np.int64)
    ls = lx = lk = ds = dx = dk = np.empty(0, np.int64)
    if found:
        near = _near(w)
        code = np.array([near.get(d, d + 120) for d in far.tolist()], np.int64)
        symbols, extra, more = _prefix(np.concatenate([size, code]))
        (ls, ds), (lx, dx), (lk, dk) = (np.split(x, [len(size)]) for x in (symbols, extra, more))
        first[copy] = 256 + ls
    cached = np.zeros(len(place), bool)
    if cache_bits:
        table, done = {}, 0
        for i, p in enumerate(place.tolist()):
            for q in range(done, p):
                table[(0x1E35A7BD * int(px[q]) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(px[q])
            done = p
            at = (0x1E35A7BD * int(px[p]) & 0xFFFFFFFF) >> (32 - cache_bits)
            if not copy[i] and table.get(at) == int(px[p]):
                first[i], cached[i] = 280 + at, True
    plain = ~copy & ~cached
    group = np.zeros(len(place), np.int64)
    out: list = [[(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]]
    if main:
        h = n // w
        many = split and (w > 1 << split or h > 1 << split)
        out.append([(int(bool(many)), 1)])
        if many:
            gw, gh = -(-w >> split), -(-h >> split)
            blocks = (np.arange(gw)[None, :] + np.arange(gh)[:, None]) % 2
            group = blocks[place // w >> split, place % w >> split]
            out.append([(split - 2, 3)])
            out += _image((0xFF000000 | blocks.ravel() << 8).astype(np.uint32), gw, False)
    if keys is not px and not cache_bits and not group.any():
        # One channel: a field for each literal, four for each reference.
        at = np.arange(len(place)) + 3 * (np.cumsum(copy) - copy)
        value, bits = np.zeros(len(place) + 3 * len(start), np.int64), np.zeros(len(place) + 3 * len(start), np.int64)
        rows = at[copy]
        value[rows + 1], bits[rows + 1], value[rows + 3], bits[rows + 3] = lx, lk, dx, dk
        for i, (where, symbols) in ((0, (at, first)), (4, (rows + 2, ds))):
            lengths = _lengths(np.bincount(symbols, minlength=ALPHABETS[i]).tolist(), 11)
            out.append(_code_fields(lengths))
            if sum(map(bool, lengths)) > 1:
                value[where], bits[where] = _codes(lengths)[symbols], np.array(lengths)[symbols]
            if not i:  # the other channels' only symbols
                out += [_few_fields([int(px[0]) >> k & 255]) for k in (16, 0, 24)]
        out.append((value, bits))
        return out
    value, bits = np.zeros((len(place), 4), np.int64), np.zeros((len(place), 4), np.int64)
    value[copy, 1], bits[copy, 1] = lx, lk
    value[copy, 3], bits[copy, 3] = dx, dk
    for k in range(int(group.max(initial=0)) + 1):
        here = group == k
        lit = here & plain
        rows = copy & here
        symbols = [(here, 0, first[here]), (lit, 1, (v[lit] >> 16 & 255).astype(np.int64)), (lit, 2, (v[lit] & 255).astype(np.int64)), (lit, 3, (v[lit] >> 24).astype(np.int64))]
        symbols.append((rows, 2, ds[rows[copy]]))
        for i, (at, column, s) in enumerate(symbols):
            alphabet = ALPHABETS[i] + ((1 << cache_bits) if cache_bits and not i else 0)
            counts = np.bincount(s, minlength=alphabet)
            lengths = _lengths(counts.tolist(), 11 if np.count_nonzero(counts) <= 512 else 15)
            out.append(_code_fields(lengths))
            if np.count_nonzero(counts) > 1:
                value[at, column], bits[at, column] = _codes(lengths)[s], np.array(lengths)[s]
    out.append((value.ravel(), bits.ravel()))
    return out


def _pack(parts: list) -> bytes:
    whole: list = []
    for listed, run in groupby(parts, lambda p: isinstance(p, list)):
        whole += [np.array([f for p in run for f in p], np.int64).reshape(-1, 2).T] if listed else run
    parts = whole
    values, bits = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    end = np.cumsum(bits)
    at = end - bits
    # Fields have 21 bits at the most, so those that start in one word of 32 bits add up exactly below 2 ** 53.
    words = np.bincount(at >> 5, (values << (at & 31)).astype(float), int(end[-1] >> 5) + 2).astype(np.int64)
    words[1:] |= words[:-1] >> 32  # what the word before hands over; its own upper half is not looked at again
    return words.astype("<u4").tobytes()[: int(end[-1] + 7) >> 3]


def _take(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference of each channel."""
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)


def _predicted(px: np.ndarray, w: int, h: int, bits: int, modes: np.ndarray) -> np.ndarray:
    v, mw, out = px.tolist(), -(-w >> bits), []
    for at in range(w * h):
        x, y = at % w, at // w
        if y == 0:
            guess = (255, 0, 0, 0) if x == 0 else _bytes(v[at - 1])
        elif x == 0:
            guess = _bytes(v[at - w])
        else:
            guess = _guess(int(modes[(y >> bits) * mw + (x >> bits)]), v[at - 1], v[at - w], v[at - w - 1], v[at - w + 1])
        a, r, g, b = ((p - q) & 255 for p, q in zip(_bytes(v[at]), guess, strict=True))
        out.append(a << 24 | r << 16 | g << 8 | b)
    return np.array(out, np.uint32)


def encode(rgba: np.ndarray, palette: bool = True, predict: int = 0, cross: tuple[int, int, int] | None = None, green: bool = False, cache: int = 0, split: int = 0) -> bytes:
    """One image of shape (height, width, 4).

    ``palette`` is used where 256 colours do; else ``predict`` (bits of a block; blocks take the 14 modes in turn), ``cross`` (three
    factors in one of 32) and ``green`` (subtract it) are transforms to apply, ``cache`` the bits of the colour cache, ``split`` those
    of a block of two groups of codes.
    """
    h, w, _ = rgba.shape
    px = np.ascontiguousarray(rgba[..., [2, 1, 0, 3]]).view("<u4").ravel().astype(np.uint32)
    parts: list = [[(0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)]]
    colours = px[:0]
    if palette:  # one channel alone is counted without sorting
        single = not ((px ^ px[0]) & 0xFFFF00FF).any()
        if single:
            levels = np.flatnonzero(np.bincount(px >> 8 & 255))
            if len(levels) <= 16:  # beyond, a palette packs nothing and one channel has short codes without it
                colours = (px[0] & 0xFFFF00FF | levels << 8).astype(np.uint32)
        else:
            colours = np.unique(px)
    width = w
    if 0 < len(colours) <= 256:
        parts.append([(1, 1), (3, 2), (len(colours) - 1, 8)])
        parts += _image(np.append(colours[:1], _take(colours[1:], colours[:-1])), len(colours), False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        width = -(-w >> pack)
        index = np.zeros((h, width << pack), np.uint32)
        index[:, :w] = np.searchsorted(colours, px).reshape(h, w)
        shifts = (np.arange(1 << pack) * (8 >> pack)).astype(np.uint32)
        packed = (index.reshape(h, width, 1 << pack) << shifts).sum(axis=2, dtype=np.uint32) if pack else index
        px = (0xFF000000 | packed << np.uint32(8)).ravel()
    else:
        if predict:
            modes = np.arange((-(-w >> predict)) * (-(-h >> predict))) % 14
            parts.append([(1, 1), (0, 2), (predict - 2, 3)])
            parts += _image((0xFF000000 | modes << 8).astype(np.uint32), -(-w >> predict), False)
            px = _predicted(px, w, h, predict, modes)
        if cross:
            factors = [x & 255 for x in cross]
            bits = 9
            blocks = (-(-w >> bits)) * (-(-h >> bits))
            parts.append([(1, 1), (1, 2), (bits - 2, 3)])
            parts += _image(np.full(blocks, 0xFF000000 | factors[2] << 16 | factors[1] << 8 | factors[0], np.uint32), -(-w >> bits), False)
            gs, rs = _signed(px >> 8), _signed(px >> 16)
            f = [_signed(np.array(x)) for x in factors]
            red = (px >> 16).astype(np.int64) - (f[0] * gs >> 5) & 255
            blue = px.astype(np.int64) - (f[1] * gs >> 5) - (f[2] * rs >> 5) & 255
            px = (px & 0xFF00FF00) | (red.astype(np.uint32) << 16) | blue.astype(np.uint32)
        if green:
            parts.append([(1, 1), (2, 2)])
            low = px >> 8 & 255
            px = _take(px, low << 16 | low)
    parts.append([(0, 1)])
    parts += _image(px, width, True, cache, split)
    body = _pack(parts)
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def store(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, images that hold it, padded by blanks, in their green channel)."""
    raw = (text or "").encode()
    payload = np.frombuffer(raw + b" " * (-len(raw) % ROW if raw else ROW), np.uint8).reshape(-1, ROW)
    out = []
    for lo in range(0, len(payload), SIDE):
        part = payload[lo : lo + SIDE]
        rgba = np.zeros((*part.shape, 4), np.uint8)
        rgba[..., 1], rgba[..., 3] = part, 255
        out.append(encode(rgba))
    return len(raw), b"".join(out)


def payload_of(images: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(i[..., 1]).tobytes() for i in images)


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                both = [store(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([n for n, _ in both], pa.int64()), pa.array([m for _, m in both], pa.binary())], ["id", "n_bytes", "media"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add ``px``: payload length, digests, size of the images, mean and number of values, all from decoded pixels."""

    @F.arrow_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")
    def look(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            data = v.as_py()
            images = decode(data)
            payload = payload_of(images)
            counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            shape = f"{images[0].shape[1]}x{sum(i.shape[0] for i in images)}"
            mean = int((counts * np.arange(256)).sum()) * 1000 // len(payload)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(data).hexdigest(), f"{shape}:{mean}:{np.count_nonzero(counts)}"))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return df.withColumn("px", look(F.col(media_col)))


def op6(spark, sf_dir):
    out = features(media(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "px.payload_bytes", "px.payload_sha256", "px.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), "px.media_sha256", "px.feature")
