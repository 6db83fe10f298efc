"""Lossless WebP (VP8L) media columns: texts stored as 8-bit samples and read back.

``decode`` reads the whole lossless format: prefix codes, groups of them, back-references, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. Codes are read by table, a pixel at a time; images of
one value per code are cut out in bulk. The writer makes one group of codes, the reader takes any number.
``encode`` writes transforms by entropy, back-references, the colour cache and optimal prefix codes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROW_BYTES = 192  # 64 pixels of three samples
MOST = 16384  # rows, or pixels of a row
_SLICE = 1 << 18
#: Bytes of a stream looked at at a time, and pixels written at a time.
_STEP, _WRITTEN = 1 << 14, 1 << 16
#: Files written and read together, bytes of their texts at most, and files too few for that.
TOGETHER, TOGETHER_BYTES, FEW = 4096, 1 << 23, 40
#: Codes worked out together.
CODES = 2048
#: Pixels by which a copy is found, and of a copy at most.
WINDOW, MOST_COPIED = 8, 4096

# fixed values of the format
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Predictors that the writer chooses from: the pixels above, right above and left above, read a row at a time.
ABOVE = (2, 3, 4)
#: The format's longest distance, and bits of a side of the writer's blocks.
MOST_FAR, BLOCK_BITS = (1 << 20) - 120, 4
#: Near places by rising distance, then by rising |dx|: the meaning of the first 120 distance codes.
NEAR = sorted(
    ((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)
)


class _Bits:
    """Reads bits from the least significant on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        byte, off = divmod(self.at, 8)
        self.at += n
        return int.from_bytes(self.data[byte : byte + (off + n + 7) // 8], "little") >> off & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        byte, off = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + 4], "little") >> off & ((1 << n) - 1)


class _Code:
    """A canonical prefix code; ``even`` is its length where all symbols have the same, else None."""

    def __init__(self, lengths: dict[int, int] | None, keys: np.ndarray | None = None) -> None:
        """Of ``lengths`` by symbol, or of ``keys``, each a length << 16 | symbol."""
        self.even = self.lookup = None
        if keys is None:
            keys = np.fromiter(lengths, dtype=np.int64, count=len(lengths)) | np.fromiter(lengths.values(), dtype=np.int64, count=len(lengths)) << 16
        if len(keys) == 1:
            self.even, self.symbols = 0, (keys & 0xFFFF).tolist()
            return
        keys.sort()
        self.sizes = keys >> 16
        self.symbols = (keys & 0xFFFF).tolist()
        self.most = int(self.sizes[-1])
        if self.sizes[0] == self.most:
            self.even = self.most
        if int((1 << (self.most - self.sizes)).sum()) != 1 << self.most:
            raise ValueError("a prefix code is not complete")

    def read(self, bits: _Bits) -> int:
        if self.even == 0:
            return self.symbols[0]
        if self.lookup is None:
            self.lookup = self.places().tolist()
        hit = self.lookup[bits.peek(self.most)]
        bits.at += hit & 15
        return hit >> 4

    def places(self) -> np.ndarray:
        """By the next ``most`` bits, the first read lowest: symbol and length."""
        if self.even == 0:
            self.most = 0
            return np.array([self.symbols[0] << 4])
        found = np.repeat(np.array(self.symbols) << 4 | self.sizes, 1 << (self.most - self.sizes))  # in the order of the codes
        return found[REVERSED[self.most]]


def _reversed(n: int) -> np.ndarray:
    """The numbers of ``n`` bits with their bits in the other order."""
    out = np.zeros(1, dtype=np.int64)
    for k in range(n):
        out = np.concatenate([out, out | 1 << (n - 1 - k)])
    return out


REVERSED = [_reversed(n) for n in range(16)]


def _begun_code(bits: _Bits, alphabet: int) -> _Code | tuple[_Code, int]:
    """A code that is told shortly, or the code of another's lengths and how many symbols of it follow."""
    byte, off = divmod(bits.at, 8)
    ahead = int.from_bytes(bits.data[byte : byte + 9], "little") >> off
    if ahead & 1:
        two, wide = ahead >> 1 & 1, ahead >> 2 & 1
        found = {ahead >> 3 & (255 if wide else 1): 1}
        size = 3 + (8 if wide else 1)
        if two:
            found[ahead >> size & 255] = 1
        bits.at += size + 8 * two
        return _Code(found)
    count, three = 4 + (ahead >> 1 & 15), ahead >> 5
    bits.at += 5 + 3 * count
    sizes = {CODE_LENGTH_ORDER[i]: n for i in range(count) if (n := three >> 3 * i & 7)}
    meta, left = _Code(sizes), alphabet
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    if meta.even == 0 and meta.symbols[0] < 16:
        count = min(alphabet, left)
        return _Code(dict.fromkeys(range(count), meta.symbols[0])) if meta.symbols[0] else _Code({0: 1})
    return meta, left


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    begun = _begun_code(bits, alphabet)
    if isinstance(begun, _Code):
        return begun
    (meta, left), lengths, at, last = begun, {}, 0, 8
    table = meta.places().tolist()
    most = (1 << meta.most) - 1
    ahead, taken, symbols = 0, 1 << 20, 0
    while at < alphabet and left:
        left -= 1
        if taken > 4000:  # some bits ahead at a time
            bits.at += taken if symbols else 0
            byte, taken = bits.at >> 3, 0
            ahead = int.from_bytes(bits.data[byte : byte + 512], "little") >> (bits.at & 7)
        hit = table[ahead & most]
        n, s = hit & 15, hit >> 4
        symbols += 1
        more = 0 if s < 16 else 2 if s == 16 else 3 if s == 17 else 7
        extra = ahead >> n & ((1 << more) - 1)
        ahead >>= n + more
        taken += n + more
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
        elif s == 16:
            for _ in range(3 + extra):
                lengths[at] = last
                at += 1
        else:
            at += 3 + extra if s == 17 else 11 + extra
    bits.at += taken if symbols else 0
    return _Code(lengths)


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits from each byte of ``parts``, and the first bit of each part."""
    data = np.frombuffer(b"".join(part + bytes(16) for part in parts), dtype=np.uint8)
    sizes = np.array([len(part) + 16 for part in parts])
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<i8").ravel(), 8 * (np.cumsum(sizes) - sizes)


def _read_codes(words: np.ndarray, first: np.ndarray, every: list[_Bits], alphabets: list[int]) -> list[_Code]:
    """``_read_code`` for many streams, with their words and first bits: a symbol of every code at a step."""
    begun = [_begun_code(bits, n) for bits, n in zip(every, alphabets)]
    own = [k for k, b in enumerate(begun) if not isinstance(b, _Code)]
    if not own:
        return begun
    tables = [begun[k][0].places() for k in own]
    lengths = np.zeros((len(own), max(alphabets) + 138), dtype=np.uint8)
    row, p = np.arange(len(own)), np.array([every[k].at for k in own]) + first[own]
    sizes = np.array([len(t) for t in tables])
    state = [row, p, np.zeros(len(own), dtype=np.int64), np.array([begun[k][1] for k in own]), np.array([alphabets[k] for k in own]), np.cumsum(sizes) - sizes, sizes - 1]
    table, ends, last = np.concatenate(tables), p.copy(), np.full(len(own), 8)
    more_of, step_of = np.zeros(19, dtype=np.int64), np.ones(19, dtype=np.int64)
    more_of[16:], step_of[16:] = (2, 3, 7), (3, 3, 11)
    while len(state[0]):
        row, p, at, left, alphabet, to, mask = state
        w = words.take(p >> 3) >> (p & 7)
        hit = table.take((w & mask) + to)
        n, s = hit & 15, hit >> 4
        more = more_of.take(s)
        step = step_of.take(s) + (w >> n & (1 << more) - 1)
        short = s < 16
        lengths[row, at] = np.where(short, s, 0)
        for i in np.flatnonzero(s == 16).tolist():
            lengths[row[i], at[i] : at[i] + step[i]] = last[row[i]]
        fresh = short & (s > 0)
        last[row[fresh]] = s[fresh]
        p += n + more
        at += step
        left -= 1
        over = (at >= alphabet) | (left == 0)
        if over.any():
            ends[row[over]] = p[over]
            state = [x[~over] for x in state]
    for k, size, end in zip(own, lengths, (ends - first[own]).tolist()):
        every[k].at = end
        symbols = np.flatnonzero(size[: alphabets[k]])
        begun[k] = _Code(None, size[symbols].astype(np.int64) << 16 | symbols)
    return begun


def _amount(prefix: int, bits: _Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _bulk(bits: _Bits, codes: list[_Code], n: int) -> np.ndarray:
    """n pixels of codes with one length each, as a matrix of A, R, G, B."""
    green, red, blue, alpha = codes[:4]
    order = [(1, red), (2, green), (3, blue), (0, alpha)]
    stream = [order[1], order[0], order[2], order[3]]
    width = sum(c.even for _, c in stream)
    out = np.empty((n, 4), dtype=np.uint8)
    data = np.frombuffer(bits.data, dtype=np.uint8)
    for at in range(0, n, _SLICE):
        to = min(n, at + _SLICE)
        lo, hi = bits.at + at * width, bits.at + to * width
        plane = np.unpackbits(data[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].reshape(to - at, width)
        off = 0
        for channel, code in stream:
            index = np.zeros(to - at, dtype=np.uint8)
            for j in range(off, off + code.even):
                index = index << 1 | plane[:, j]
            out[at:to, channel] = np.array(code.symbols, dtype=np.uint8)[index]
            off += code.even
    bits.at += n * width
    return out


def _far(bits: _Bits, code: _Code, width: int) -> int:
    """How many pixels back a copy begins."""
    far = _amount(code.read(bits), bits)
    if far > len(NEAR):
        return far - len(NEAR)
    dx, dy = NEAR[far - 1]
    return max(1, dx + dy * width)


def _varied(bits: _Bits, codes: list[_Code], n: int, width: int, cache_bits: int, begun: list[int] | None = None) -> np.ndarray:
    """n pixels of one group of codes as a matrix of A, R, G, B; those in ``begun`` have been read.

    A code's table holds what its symbol adds to a pixel, over 6 bits of its length, so that a pixel is three lookups and
    a sum. Copies and the colour cache go by the pixels in order.
    """
    green, red, blue, alpha = (c.places() for c in codes[:4])
    length_of = lambda t: t & 15
    kind = green >> 4
    first = (np.where(kind < 256, kind << 8, (kind << 8) + (1 << 40)) << 6 | length_of(green)).tolist()
    reds, blues, alphas = ((x >> 4 << up << 6 | length_of(x)).tolist() for x, up in ((red, 16), (blue, 0), (alpha, 24)))
    gm, rm, bm, am = ((1 << c.most) - 1 for c in codes[:4])
    constant = alphas[0] >> 6 if not am else 0
    literal = 1 << 46
    data = np.frombuffer(bits.data[bits.at // 8 :] + bytes(24), dtype=np.uint8)
    bits_from = bits.at // 8 * 8
    p, out, last = bits.at - bits_from, begun or [], 0
    words, base = [], 0
    cache, slots = {}, 32 - cache_bits
    while len(out) < n:
        byte = p >> 3
        if byte - base >= len(words):  # 64 bits from each byte of the next stretch
            base = byte
            part = data[base : base + _STEP + 8]
            words = np.lib.stride_tricks.sliding_window_view(part, 8).copy().view("<u8").ravel().tolist()
        w = words[byte - base] >> (p & 7)
        g = first[w & gm]
        if g < literal:
            w >>= g & 63
            r = reds[w & rm]
            g += r + blues[w >> (r & 63) & bm]
            p += g & 63
            if am:
                bits.at = p + bits_from
                a = alphas[bits.peek(am.bit_length())]
                p += a & 63
                out.append(g >> 6 | a >> 6)
            else:
                out.append(g >> 6 | constant)
            continue
        p += g & 63
        s = (g >> 14) - (1 << 32)
        if s >= LENGTH_CODES + 256:
            for v in out[last:]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> slots] = v
            last = len(out)
            out.append(cache.get(s - LENGTH_CODES - 256, 0))
            continue
        bits.at = p + bits_from
        length, far = _amount(s - 256, bits), _far(bits, codes[4], width)
        p, at = bits.at - bits_from, len(out)
        out += out[at - far : at - far + length] if far >= length else (out[at - far :] * (length // far + 1))[:length]
    bits.at = p + bits_from
    return np.array(out, dtype=">u4").view(np.uint8).reshape(n, 4)


def _header(bits: _Bits, width: int, height: int, main: bool) -> tuple:
    """What stands before the pixels of an image: bits of the colour cache, codes of each group, the groups of blocks."""
    cache_bits, groups, group_of, shift, sizes = _told(bits, width, height, main)
    return cache_bits, [[_read_code(bits, n) for n in sizes] for _ in range(groups)], group_of, shift


def _told(bits: _Bits, width: int, height: int, main: bool) -> tuple:
    """Bits of the colour cache, number of groups, the group of each block, bits of a block's side, and the alphabets."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups, group_of, shift = 1, None, 0
    if main and bits.take(1):
        shift = bits.take(3) + 2
        chosen = _image(bits, -(-width >> shift), -(-height >> shift))
        group_of = chosen[:, 1].astype(int) << 8 | chosen[:, 2]
        groups = int(group_of.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    return cache_bits, groups, group_of, shift, sizes


def _image(bits: _Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as a matrix of A, R, G, B, a row per pixel."""
    return _pixels(bits, width, height, _header(bits, width, height, main), main)


def _even(codes: list[_Code]) -> bool:
    return all(c.even is not None for c in codes[:4]) and max(codes[0].symbols) < 256


def _pixels(bits: _Bits, width: int, height: int, header: tuple, main: bool) -> np.ndarray:
    cache_bits, codes, group_of, shift = header
    n, across, cache_size = width * height, -(-width >> shift), 1 << cache_bits if cache_bits else 0
    if main and len(codes) == 1 and _even(codes[0]):
        return _bulk(bits, codes[0], n)
    if len(codes) == 1:
        return _varied(bits, codes[0], n, width, cache_bits)
    out, cache, at = [0] * n, [0] * cache_size, 0
    remember = lambda p: cache.__setitem__((CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits), p) if cache_size else None
    while at < n:
        own = codes[group_of[(at // width >> shift) * across + (at % width >> shift)] if group_of is not None else 0]
        s = own[0].read(bits)
        if s < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            remember(out[at])
            at += 1
        elif s < 256 + LENGTH_CODES:
            length, far = _amount(s - 256, bits), _far(bits, own[4], width)
            if not cache_size:
                again = out[at - far : at - far + length] if far >= length else (out[at - far : at] * (length // far + 1))[:length]
                out[at : at + length] = again
                at += length
                continue
            for _ in range(length):
                out[at] = out[at - far]
                remember(out[at])
                at += 1
        else:
            out[at] = cache[s - 256 - LENGTH_CODES]
            remember(out[at])
            at += 1
    return np.array(out, dtype=">u4").view(np.uint8).reshape(n, 4)


def _half(a, b):
    return (a + b) // 2


def _predict(mode: int, left, top, right_top, left_top):
    """The prediction of a pixel from its neighbours, each an integer array of four channels."""
    if mode == 11:
        near = np.abs(top - left_top).sum(), np.abs(left - left_top).sum()
        return left if near[0] < near[1] else top
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        step = mean - left_top
        return np.clip(mean + np.sign(step) * (np.abs(step) // 2), 0, 255)
    return {
        1: left,
        2: top,
        3: right_top,
        4: left_top,
        5: _half(_half(left, right_top), top),
        6: _half(left, left_top),
        7: _half(left, top),
        8: _half(left_top, top),
        9: _half(top, right_top),
        10: _half(_half(left, left_top), _half(top, right_top)),
    }.get(mode, np.array([255, 0, 0, 0]))


def predictor(pixels: np.ndarray, width: int, modes: np.ndarray, shift: int, invert: bool) -> np.ndarray:
    """Takes predictions from pixels, or puts them back; one mode per block of 2^shift pixels a side."""
    across, out = -(-width >> shift), pixels.astype(np.int64)
    seen = out if invert else pixels.astype(np.int64)
    sign = 1 if invert else -1
    result = out if invert else out.copy()
    for y in range(len(pixels) // width):
        row, modes_here = y * width, modes[(y >> shift) * across : (y >> shift) * across + across]
        if y and np.isin(modes_here, ABOVE).all():  # rows above alone: all of the row at once
            result[row] = (out[row] + sign * seen[row - width]) & 255
            above = np.concatenate([seen[row - width : row], seen[row : row + 1]])  # right of the last is this row's first
            each, guess = np.repeat(modes_here, 1 << shift)[1:width, None], above[1:-1]
            guess = np.where(each == 3, above[2:], np.where(each == 4, above[:-2], guess))
            result[row + 1 : row + width] = (out[row + 1 : row + width] + sign * guess) & 255
            continue
        for i in range(row, row + width):
            x = i - row
            if not i:
                guess = np.array([255, 0, 0, 0])
            elif not y:
                guess = seen[i - 1]
            elif not x:
                guess = seen[i - width]
            else:
                guess = _predict(int(modes_here[x >> shift]), seen[i - 1], seen[i - width], seen[i - width + 1], seen[i - width - 1])
            result[i] = (out[i] + sign * guess) & 255
    return result.astype(np.uint8)


def cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, shift: int, invert: bool) -> np.ndarray:
    """Takes out of red and blue what the green of a pixel, and for blue its red, foretell, or puts it back."""
    across, at = -(-width >> shift), np.arange(len(pixels))
    own = elements[(at // width >> shift) * across + (at % width >> shift)]
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    delta = lambda t, c: signed(t) * signed(c) >> 5
    sign, out, green = (1 if invert else -1), pixels.copy(), pixels[:, 2]
    red = (pixels[:, 1] + sign * delta(own[:, 3], green)) & 255
    before = red if invert else pixels[:, 1]
    blue = (pixels[:, 3] + sign * (delta(own[:, 2], green) + delta(own[:, 1], before))) & 255
    out[:, 1], out[:, 3] = red, blue
    return out


def _together(files: list[tuple[_Bits, list[_Code], int, int, int]], words: np.ndarray, first_bit: np.ndarray) -> list[np.ndarray]:
    """``_varied`` of many images (its arguments each, ``_words``) with constant alpha: one symbol of every image at a step.

    Copies go by one; images that outlast all but FEW others are read on by themselves.
    """
    sizes = np.array([f[2] for f in files])
    start = np.cumsum(sizes) - sizes
    out, at, stop = np.zeros(int(sizes.sum()), dtype=np.int64), start.copy(), start + sizes
    p = first_bit + np.array([f[0].at for f in files])
    tables, offsets, masks = [], [], []
    for k, up in enumerate((8, 16, 0)):  # what a symbol adds to a pixel, over 6 bits of its length
        own = [f[1][k].places() for f in files]
        every = np.concatenate(own)
        tables.append(((every >> 4 << up << 6) | (every & 15)).astype(np.int32))
        offsets.append(np.cumsum([0] + [len(t) for t in own])[:-1])
        masks.append(np.array([len(t) - 1 for t in own]))
    alpha = np.array([f[1][3].symbols[0] << 24 for f in files])
    slots = np.array([32 - f[4] for f in files])
    cached = np.array([1 << f[4] for f in files])
    cache, cache_at = np.zeros(int(cached.sum()), dtype=np.int64), np.cumsum(cached) - cached
    any_cache, own = max(f[4] for f in files) > 0, np.arange(len(files))
    state = [p, at, stop, *offsets, *masks, alpha, slots, cache_at, own]
    low, factor, first = 0xFFFFFFFF, CACHE_FACTOR, 256 << 14
    while len(state[0]) > FEW:
        p, at, stop, go, ro, bo, gm, rm, bm, alpha, slots, cache_at, own = state
        w = words.take(p >> 3) >> (p & 7)
        g = tables[0].take((w & gm) + go)
        w >>= g & 63
        r = tables[1].take((w & rm) + ro)
        w >>= r & 63
        every = g + r + tables[2].take((w & bm) + bo)
        value, taken = alpha | every >> 6, every & 63
        late = np.flatnonzero(g >= first)
        again = ()
        if len(late):
            taken[late] = g[late] & 63
            symbol = g[late] >> 14
            hit = late[symbol >= 256 + LENGTH_CODES]
            value[hit] = cache[cache_at[hit] + (symbol[symbol >= 256 + LENGTH_CODES] - 256 - LENGTH_CODES)]
            again = late[symbol < 256 + LENGTH_CODES].tolist()
        p += taken
        ahead = 1
        if again:
            ahead = np.ones(len(p), dtype=np.int64)
            for i in again:  # copies
                bits, codes, _, width, cache_bits = files[own[i]]
                from_bit = int(first_bit[own[i]])
                bits.at = int(p[i]) - from_bit
                length, far = _amount(int(g[i] >> 14) - 256, bits), _far(bits, codes[4], width)
                p[i], to = bits.at + from_bit, int(at[i])
                part = out[to - far : to - far + min(far, length)]
                out[to : to + length] = part = np.resize(part, length)
                if cache_bits:
                    cache[cache_at[i] + ((part * factor & low) >> slots[i])] = part
                value[i], ahead[i] = part[0], length
        out[at] = value
        if any_cache:
            if again:
                value[again] = out[at[again] + ahead[again] - 1]
            cache[cache_at + ((value * factor & low) >> slots)] = value
        at += ahead
        if (at >= stop).any():
            left = np.flatnonzero(at < stop)
            for i in np.flatnonzero(at >= stop).tolist():
                files[own[i]][0].at = int(p[i] - first_bit[own[i]])
            state = [x[left] for x in state]
    rest = dict(zip(state[-1].tolist(), zip(state[0].tolist(), state[1].tolist())))
    found = []
    for k, (bits, codes, n, width, cache_bits) in enumerate(files):
        if k in rest:
            bits.at = rest[k][0] - int(first_bit[k])
            found.append(_varied(bits, codes, n, width, cache_bits, out[start[k] : rest[k][1]].tolist()))
        else:
            found.append(out[start[k] : start[k] + n].astype(">u4").view(np.uint8).reshape(n, 4))
    return found


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` of many files, their pixels read together."""
    opened = [_opened(data) for data in files]
    if len(files) <= FEW:
        return [_closed(*o, _header(o[0], o[4], o[2], True)) for o in opened]
    words, first = _words([o[0].data for o in opened])
    told = [_told(o[0], o[4], o[2], True) for o in opened]
    codes: list[list] = [[] for _ in opened]
    single = [k for k, t in enumerate(told) if t[1] == 1]
    for c in range(5):
        for k, code in zip(single, _read_codes(words, first[single], [opened[k][0] for k in single], [told[k][4][c] for k in single])):
            codes[k].append(code)
    headers = []
    for (bits, *_), (cache_bits, groups, group_of, shift, sizes), own in zip(opened, told, codes):
        headers.append((cache_bits, [own] if groups == 1 else [[_read_code(bits, n) for n in sizes] for _ in range(groups)], group_of, shift))
    own, read = [k for k in single if not _even(codes[k]) and codes[k][3].even == 0], {}
    if len(own) > FEW:
        read = dict(zip(own, _together([(opened[k][0], codes[k], opened[k][4] * opened[k][2], opened[k][4], told[k][0]) for k in own], words, first[own])))
    return [_closed(*o, header, read.get(k)) for k, (o, header) in enumerate(zip(opened, headers))]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: height x width x 4, in the order A, R, G, B."""
    return decode_many([data])[0]


def _opened(data: bytes) -> tuple:
    """The bits of a file, its size, transforms and inner width, all before the header of its pixels read."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = _Bits(data[21:])
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(4)
    transforms, inner = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.take(3) + 2
            extra = (shift, _image(bits, -(-inner >> shift), -(-height >> shift)))
        elif kind == PALETTE:
            size = bits.take(8) + 1
            colours = np.cumsum(_image(bits, size, 1).astype(np.int64), axis=0).astype(np.uint8)
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            extra = (pack, colours)
        else:
            extra = None
        transforms.append((kind, inner, extra))
        if kind == PALETTE:
            inner = -(-inner >> pack)
    return bits, width, height, transforms, inner


def _closed(bits: _Bits, width: int, height: int, transforms: list, inner: int, header: tuple, pixels: np.ndarray | None = None) -> np.ndarray:
    """The pixels of an opened file, with its transforms taken back."""
    if pixels is None:
        pixels = _pixels(bits, inner, height, header, True)
    for kind, wide, extra in reversed(transforms):
        if kind == PREDICTOR:
            pixels = predictor(pixels, wide, extra[1][:, 2], extra[0], True)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, wide, extra[1], extra[0], True)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[:, 1] += pixels[:, 2]
            pixels[:, 3] += pixels[:, 2]
        else:
            pack, colours = extra
            size = 8 >> pack
            packed = pixels[:, 2].reshape(height, -1)
            index = (packed[:, :, None] >> (size * np.arange(1 << pack))) & ((1 << size) - 1)
            index = index.reshape(height, -1)[:, :wide].ravel()
            full = np.zeros((256, 4), dtype=np.uint8)
            full[: len(colours)] = colours
            pixels = full[index]
    return pixels.reshape(height, width, 4)


class Writer:
    """Writes bits from the least significant on; whole bytes are packed once many values have come."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.small: list[tuple[int, int]] = []
        self.bytes: list[bytes] = []
        self.held = 0

    def put(self, value: int, n: int) -> None:
        self.small.append((value, n))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Writes the lowest bits of each value."""
        self._settle()
        self.values.append(values)
        self.sizes.append(sizes)
        self.held += len(values)
        if self.held > _WRITTEN:
            self._pack(False)

    def flags(self, bits: np.ndarray) -> None:
        self.many(bits.astype(np.int64), np.ones(len(bits), dtype=np.int64))

    def _settle(self) -> None:
        if self.small:
            small, self.small = np.array(self.small, dtype=np.int64), []
            self.values.append(small[:, 0])
            self.sizes.append(small[:, 1])

    def _pack(self, last: bool) -> None:
        if not self.values:
            return
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        stop = np.cumsum(sizes)
        start, n = stop - sizes, int(stop[-1])
        if int(sizes.max(initial=0)) <= 48:  # as bytes that add up, as no two values share a bit
            low = (values & (1 << sizes) - 1) << (start & 7)
            at = (start >> 3)[:, None] + np.arange(7)
            whole = np.bincount(at.ravel(), low.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :7].ravel(), minlength=(n + 7) // 8)[: (n + 7) // 8].astype(np.uint8)
        else:
            at = np.arange(n) - np.repeat(start, sizes)
            whole = np.packbits((np.repeat(values, sizes) >> at & 1).astype(np.uint8), bitorder="little")
        left = 0 if last else n % 8
        self.bytes.append(whole[: len(whole) - (left > 0)].tobytes())
        self.values, self.sizes, self.held = [whole[-1:].astype(np.int64)] if left else [], [np.array([left])] if left else [], 0

    def data(self) -> bytes:
        self._settle()
        self._pack(True)
        return b"".join(self.bytes)


def _even_code(out: Writer, values: np.ndarray, alphabet: int) -> tuple[np.ndarray, int]:
    """Writes a code of one length for the bytes in ``values``: (the code of each byte, its bits)."""
    used = np.bincount(values, minlength=256) > 0
    n = int(used.sum())
    if n == 1:
        out.put(0b101, 3)  # a simple code of one symbol of 8 bits
        out.put(int(np.flatnonzero(used)[0]), 8)
        return np.zeros(256, dtype=np.uint8), 0
    size = (n - 1).bit_length()
    used[np.flatnonzero(~used)[: (1 << size) - n]] = True  # a code must be complete
    last = max(CODE_LENGTH_ORDER.index(0), CODE_LENGTH_ORDER.index(size))
    out.put(0, 1)
    out.put(last - 3, 4)
    for i in range(last + 1):
        out.put(CODE_LENGTH_ORDER[i] in (0, size), 3)
    out.put(0, 1)
    flags = np.zeros(alphabet, dtype=np.uint8)
    flags[:256] = used
    out.flags(flags)  # one bit a symbol: length 0 or ``size``
    return (np.cumsum(used) - 1).astype(np.uint8), size


def _lengths(counts: np.ndarray, most: int = 15) -> dict[int, int]:
    """Lengths of an optimal prefix code for the symbols that occur, ``most`` at most: rarer ones count as more where one would be longer."""
    used = np.flatnonzero(counts)
    weights = counts[used]
    while True:
        order = np.argsort(weights, kind="stable")
        n = len(order)
        leaves, inner, up = [*weights[order].tolist(), math.inf, math.inf], [], [0] * (2 * n)
        a = b = 0  # the least leaf and the least joined pair not taken yet
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if b >= len(inner) or leaves[a] <= inner[b]:
                    total += leaves[a]
                    up[a] = new
                    a += 1
                else:
                    total += inner[b]
                    up[n + b] = new
                    b += 1
            inner.append(total)
        depth = [0] * (2 * n)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[:n]) <= most:
            found = np.empty(n, dtype=np.int64)
            found[order] = depth[:n]
            return dict(zip(used.tolist(), found.tolist()))
        weights = (weights + 1) // 2


def _lengths_of(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """``_lengths`` of each row of ``counts``, of two symbols at least; 0 for symbols that don't occur. All rows join a pair at a step."""
    if len(counts) <= 16:
        found = np.zeros(counts.shape, dtype=np.int64)
        for own, row in zip(found, counts):
            for one, size in _lengths(row, most).items():
                own[one] = size
        return found
    used = np.count_nonzero(counts, axis=1)
    rank = np.argsort(-used, kind="stable")
    counts, used = counts[rank], used[rank]
    n, widest, big = len(used), int(used[0]), np.iinfo(np.int64).max
    of, symbol = np.nonzero(counts)
    keys = np.sort(of << 48 | counts[of, symbol] << 12 | symbol)  # by row, weight and symbol
    place = np.arange(len(of)) - (np.cumsum(used) - used)[of]
    leaves, order = np.full((n, widest + 1), big), np.zeros((n, widest), dtype=np.int64)
    leaves[of, place], order[of, place] = keys >> 12 & ((1 << 36) - 1), keys & 4095
    inner, up = np.full((n, widest + 1), big), np.zeros((n, 2 * (widest + 1)), dtype=np.int64)
    a, b, row = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)
    active = np.searchsorted(-used, -np.arange(1, widest + 1), side="left")  # rows with more symbols than 1, 2, ...
    for new in range(widest - 1):
        m = int(active[new])
        rows, total = row[:m], 0
        for _ in range(2):
            leaf, pair = leaves[rows, a[:m]], inner[rows, b[:m]]
            first = leaf <= pair
            total = total + np.where(first, leaf, pair)
            up[rows, np.where(first, a[:m], widest + 1 + b[:m])] = new
            a[:m] += first
            b[:m] += ~first
        inner[:m, new] = total
    depth = np.zeros((n, widest + 1), dtype=np.int64)  # of joined pairs; the last of a row is its root
    for k in range(widest - 3, -1, -1):
        m = int(active[k + 1])
        depth[:m, k] = depth[row[:m], up[:m, widest + 1 + k]] + 1
    found = np.zeros(counts.shape, dtype=np.int64)
    found[rank[of], order[of, place]] = depth[of, up[of, place]] + 1
    back = np.argsort(rank)
    for k in np.flatnonzero(found.max(axis=1) > most).tolist():
        found[k] = 0
        for one, size in _lengths(counts[back[k]], most).items():
            found[k, one] = size
    return found


def _canonical_of(sizes: np.ndarray) -> np.ndarray:
    """``_canonical`` of each row of lengths, without the lengths."""
    row, symbol = np.nonzero(sizes)
    own = sizes[row, symbol]
    order = np.lexsort((symbol, own, row))
    steps = 1 << (15 - own[order])
    stop = np.cumsum(steps)
    begun = np.concatenate([[0], stop])[np.searchsorted(row[order], row[order], side="left")]
    codes = np.zeros(sizes.shape, dtype=np.int64)
    codes[row[order], symbol[order]] = REVERSED[15][stop - steps - begun]  # codes from their upper end, the other way round
    return codes


def _codes_of(counts: np.ndarray, alphabets: np.ndarray) -> list[tuple]:
    """Of each row of ``counts`` (two symbols at least, of its alphabet): what writes its optimal code, values and sizes, then bits and their number of each symbol."""
    n = len(counts)
    sizes = _lengths_of(counts)
    ended = np.concatenate([counts, np.zeros((n, 1), dtype=np.int64)], axis=1)
    ended[np.arange(n), alphabets] = 1
    row, symbol = np.nonzero(ended)
    last = np.concatenate([[-1], np.where(row[1:] == row[:-1], symbol[:-1], -1)])
    gap = symbol - last - 1
    whole, rest = gap // 138, gap % 138
    own = (symbol < alphabets[row]).astype(np.int64)
    parts = whole + np.where(rest >= 3, 1, rest) + own  # stretches without any, then the length
    stop = np.cumsum(parts)
    which = np.repeat(np.arange(len(row)), parts)
    at, left = np.arange(int(stop[-1])) - (stop - parts)[which], rest[which]
    full, is_length = at < whole[which], (at == parts[which] - 1) & (own[which] > 0)
    kind = np.where(full | (left >= 11), 18, np.where(left >= 3, 17, 0))
    more = np.where(full, 127, np.where(left >= 11, left - 11, np.where(left >= 3, left - 3, 0)))
    length = sizes[row, np.minimum(symbol, counts.shape[1] - 1)][which]
    kind, more = np.where(is_length, length, kind), np.where(is_length, 0, more)
    more_bits = np.where(kind == 18, 7, np.where(kind == 17, 3, 0))
    of = row[which]
    meta = np.bincount(of * 19 + kind, minlength=19 * n).reshape(n, 19)
    single = np.count_nonzero(meta, axis=1) == 1
    meta[single, np.where(meta[single, 0] == 0, 0, 1)] += 1
    meta_sizes = _lengths_of(meta, 7)
    short = _canonical_of(meta_sizes)
    values, widths = short[of, kind] | more << meta_sizes[of, kind], meta_sizes[of, kind] + more_bits
    ordered = meta_sizes[:, CODE_LENGTH_ORDER]
    kept = np.maximum(4, 19 - np.argmax(ordered[:, ::-1] > 0, axis=1))
    zero = np.zeros((n, 1), dtype=np.int64)
    heads = np.concatenate([zero, kept[:, None] - 4, ordered, zero], axis=1)
    head_sizes = np.concatenate([zero + 1, zero + 4, np.where(np.arange(19) < kept[:, None], 3, 0), zero + 1], axis=1)
    codes, ends = _canonical_of(sizes), np.searchsorted(of, np.arange(n + 1))
    return [
        (np.concatenate([heads[k], values[ends[k] : ends[k + 1]]]), np.concatenate([head_sizes[k], widths[ends[k] : ends[k + 1]]]), codes[k], sizes[k])
        for k in range(n)
    ]


def _codes(counts: list[np.ndarray]) -> list[tuple]:
    """``_codes_of`` for symbols by their counts, a code each; CODES of them worked out together."""
    found: list[tuple] = [()] * len(counts)
    own = []
    for k, c in enumerate(counts):
        used = np.flatnonzero(c)
        if len(used) <= 1 and (not len(used) or used[0] < 256):
            none = np.zeros(len(c), dtype=np.int64)
            found[k] = np.array([0b101, used[0] if len(used) else 0]), np.array([3, 8]), none, none
        else:
            own.append(k)
    own.sort(key=lambda k: len(counts[k]))
    for lo in range(0, len(own), CODES):
        part = own[lo : lo + CODES]
        alphabets = np.array([len(counts[k]) for k in part])
        rows = np.zeros((len(part), int(alphabets.max())), dtype=np.int64)
        for row, k in zip(rows, part):
            row[: len(counts[k])] = counts[k]
        rows[np.count_nonzero(rows, axis=1) == 1, 0] += 1  # a code of one late symbol has no short form
        for k, made in zip(part, _codes_of(rows, alphabets)):
            found[k] = made
    return found


def _prefix(amount: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    x = amount - 1
    if x < 4:
        return x, 0, 0
    top = x.bit_length() - 1
    return 2 * top + (x >> (top - 1) & 1), x & ((1 << (top - 1)) - 1), top - 1


def _matches(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches of pixels that were met before, by the hash of WINDOW pixels; none overlaps another."""
    n = len(values) - WINDOW + 1
    if n < 2:
        return []
    hashes, times, wide = values, np.full(1, 0x9E3779B97F4A7C15, dtype=np.uint64), 1
    while wide < WINDOW:  # of twice as many pixels
        hashes, times, wide = hashes[:-wide] * times + hashes[wide:], times * times, 2 * wide
    bits = np.uint64(n.bit_length())  # sorted by the upper bits of the hash, then by place
    keys = np.sort(hashes >> bits << bits | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero(keys[1:] >> bits == keys[:-1] >> bits)
    if not len(same):
        return []
    order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[same + 1]] = order[same]
    before[np.arange(n) - before > MOST_FAR] = -1
    places = np.flatnonzero(before >= 0)
    found, at = [], 0
    while (k := int(np.searchsorted(places, at))) < len(places):
        at = int(places[k])
        far, length = at - int(before[at]), 0
        while at + length < len(values) and length < MOST_COPIED:
            part = values[at + length : at + length + MOST_COPIED - length]
            differs = np.flatnonzero(part != values[at + length - far : at + length - far + len(part)])
            length += int(differs[0]) if len(differs) else len(part)
            if len(differs):
                break
        if length >= WINDOW:
            found.append((at, length, far))
        at += max(length, 1)
    return found


def _bits_of(*counts: np.ndarray) -> float:
    """Bits that symbols with these counts need by their entropies."""
    every = np.concatenate(counts)
    every = every[every > 1]
    totals = [c for c in (int(c.sum()) for c in counts) if c]
    return sum(c * math.log2(c) for c in totals) - float((every * np.log2(every)).sum())


def _spread(*channels: np.ndarray) -> float:
    """Bits that the samples of each channel need by their entropies."""
    return _bits_of(*[np.bincount(c, minlength=256) for c in channels])


def _cached(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each pixel in a colour cache of ``bits`` bits, and whether it is found there."""
    slot = ((values * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = np.argsort(slot.astype(np.uint16), kind="stable")  # by radix
    again = np.zeros(len(values), dtype=bool)
    again[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    return slot, again


def _put_image(out: Writer, pixels: np.ndarray) -> None:
    """Writes a small image of pixels A, R, G, B."""
    plan = _planned(pixels, False)
    _put_planned(out, plan, _codes(plan[0]))


def _planned(pixels: np.ndarray, main: bool) -> tuple:
    """Counts of the symbols of pixels A, R, G, B, and where they come from: back-references wherever pixels recur, the colour cache where it saves bits."""
    n, (alpha, red, green, blue) = len(pixels), (pixels[:, k].astype(np.int64) for k in range(4))
    values = (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint64)
    matches = _matches(values)
    literal = np.ones(n, dtype=bool)
    for place, length, _ in matches:
        literal[place : place + length] = False
    copies = [(_prefix(length), _prefix(far + len(NEAR))) for _, length, far in matches]
    lengths = np.bincount([c[0][0] for c in copies], minlength=LENGTH_CODES).astype(np.int64) if copies else np.zeros(LENGTH_CODES, dtype=np.int64)
    far = np.bincount([c[1][0] for c in copies], minlength=DISTANCE_CODES) if copies else np.zeros(DISTANCE_CODES, dtype=np.int64)

    def counted(own: np.ndarray, slots: np.ndarray | None, size: int) -> list[np.ndarray]:
        first = np.concatenate([np.bincount(green[own], minlength=256), lengths, np.bincount(slots, minlength=size) if size else np.zeros(0, dtype=np.int64)])
        return [first, *[np.bincount(c[own], minlength=256) for c in (red, blue, alpha)]]

    cache_bits, slot, again, counts = 0, None, np.zeros(n, dtype=bool), counted(literal, None, 0)
    if main and literal.sum() > 64:
        most = min(10, int(literal.sum()).bit_length() - 1)
        at, hit = _cached(values, most)
        hit &= literal
        other = counted(literal & ~hit, at[hit], 1 << most)
        if _bits_of(*other) + 9 * np.count_nonzero(other[0][256 + LENGTH_CODES :]) < _bits_of(*counts):
            cache_bits, slot, again, counts = most, at, hit, other
    return [*counts, far], pixels, main, cache_bits, None if slot is None else slot.astype(np.int16), again, literal, matches, copies


def _put_planned(out: Writer, plan: tuple, codes: list[tuple]) -> None:
    """Writes planned pixels by their codes."""
    _, pixels, main, cache_bits, slot, again, literal, matches, copies = plan
    n, (alpha, red, green, blue) = len(pixels), pixels.T
    starts = np.array([m[0] for m in matches], dtype=np.int64)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # one group of codes
    for values, sizes, _, _ in codes:
        out.many(values, sizes)
    codes = [c[2:] for c in codes]
    kept = literal.copy()
    kept[starts] = True
    kept = np.flatnonzero(kept)
    copied = {m[0]: c for m, c in zip(matches, copies)}
    for lo in range(0, len(kept), _WRITTEN):
        at = kept[lo : lo + _WRITTEN]
        value, size = (x[green[at]] for x in codes[0])
        for channel, (code, bits) in zip((red, blue, alpha), codes[1:4]):
            value, size = value | code[channel[at]] << size, size + bits[channel[at]]
        if cache_bits:
            found = again[at]
            symbols = 256 + LENGTH_CODES + slot[at[found]]
            value[found], size[found] = codes[0][0][symbols], codes[0][1][symbols]
        for i in np.flatnonzero(~literal[at]).tolist():
            (length, more, more_bits), (away, rest, rest_bits) = copied[int(at[i])]
            v, b = int(codes[0][0][256 + length]), int(codes[0][1][256 + length])
            for x, m in ((more, more_bits), (int(codes[4][0][away]), int(codes[4][1][away])), (rest, rest_bits)):
                v, b = v | x << b, b + m
            value[i], size[i] = v, b
        out.many(value, size)


def _foretold(pixels: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The predictor of ABOVE that leaves least in each block, and about what is left of R, G and B."""
    wide, high = -(-width >> BLOCK_BITS), -(-height >> BLOCK_BITS)
    rgb, left, costs = np.ascontiguousarray(pixels[:, 1:]), [], []
    for back in (width, width - 1, width + 1):
        rest = rgb.copy()
        rest[back:] -= rgb[: max(0, len(rgb) - back)]
        left.append(rest)
        cost = np.zeros((high << BLOCK_BITS, wide << BLOCK_BITS), dtype=np.int32)
        small = np.minimum(rest, -rest).astype(np.int32)
        cost[:height, :width] = (small[:, 0] + small[:, 1] + small[:, 2]).reshape(height, width)
        costs.append(cost.reshape(high, 1 << BLOCK_BITS, wide, 1 << BLOCK_BITS).sum(axis=(1, 3)))
    best = np.argmin(costs, axis=0)
    block = np.repeat(np.repeat(best, 1 << BLOCK_BITS, axis=0)[:height], 1 << BLOCK_BITS, axis=1)[:, :width].reshape(-1, 1)
    return np.array(ABOVE)[best.ravel()], np.where(block == 0, left[0], np.where(block == 1, left[1], left[2]))


def _put_transforms(out: Writer, pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Writes the transforms by which the entropy of pixels is least, and returns what is left to write."""
    least = _spread(*pixels.T[1:])
    order = np.sort(pixels.view(">u4").ravel().astype(np.uint32))
    colours = order[np.concatenate([[True], order[1:] != order[:-1]])]
    if len(colours) <= 256:
        index = np.searchsorted(colours, pixels.view(">u4").ravel())
        if _bits_of(np.bincount(index)) + 24 * len(colours) < least:
            out.put(1 | PALETTE << 1, 3)
            out.put(len(colours) - 1, 8)
            table = colours.astype(">u4").view(np.uint8).reshape(-1, 4)
            _put_image(out, np.diff(table.astype(np.int64), axis=0, prepend=0).astype(np.uint8))
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            across = -(-width >> pack)
            own = np.zeros((height, across << pack), dtype=np.int64)
            own[:, :width] = index.reshape(height, width)
            packed = (own.reshape(height, across, 1 << pack) << (8 >> pack) * np.arange(1 << pack)).sum(axis=2).ravel()
            left = np.zeros((len(packed), 4), dtype=np.uint8)
            left[:, 0], left[:, 2] = 255, packed
            return left
    modes, rest = _foretold(pixels, width, height)
    if (cost := _spread(*rest.T) + 4 * len(modes) + 64) < least:
        least = cost
        out.put(1 | PREDICTOR << 1, 3)
        out.put(BLOCK_BITS - 2, 3)
        chosen = np.zeros((len(modes), 4), dtype=np.uint8)
        chosen[:, 0], chosen[:, 2] = 255, modes
        _put_image(out, chosen)
        pixels = predictor(pixels, width, modes, BLOCK_BITS, False)
    _, red, green, blue = (np.ascontiguousarray(c) for c in pixels.T)
    signed = [c.view(np.int8).astype(np.int16) for c in (red, green, blue)]
    g = signed[1].astype(float)
    square = max(1.0, float((g * g).sum()))
    times = [int(np.clip(round(32 * float((g * c).sum()) / square), -128, 127)) for c in (signed[0], signed[2])]
    foretold = [(c - (t * signed[1] >> 5).astype(np.uint8)) for c, t in zip((red, blue), times)]
    own = _spread(green)
    plain, cross = own + _spread(red - green, blue - green), own + _spread(*foretold) + 80
    if plain < min(least, cross):
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = pixels.copy()
        pixels[:, 1], pixels[:, 3] = red - green, blue - green
    elif cross < least:
        out.put(1 | CROSS_COLOUR << 1, 3)
        out.put(9 - 2, 3)
        element = np.array([255, 0, times[1] & 255, times[0] & 255], dtype=np.uint8)  # of blue by green, of red by green
        element = np.tile(element, (-(-width >> 9) * -(-height >> 9), 1))
        _put_image(out, element)
        pixels = cross_colour(pixels, width, element, 9, False)
    return pixels


def _helped(images: list[np.ndarray], width: int) -> np.ndarray:
    """Of images (pixels A, R, G, B) of one width, whether any of the writer's transforms may leave less entropy, worked out for all at once.

    Figures are those of ``_put_transforms``, which then chooses; what ties but for rounding may be helped.
    """
    k, size = len(images), np.array([len(x) for x in images])
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(k), size)
    at = np.arange(len(of)) - start[of]
    every = np.concatenate(images)
    red, green, blue = (np.ascontiguousarray(every[:, c]) for c in (1, 2, 3))
    logs = np.arange(int(size.max()) + 1, dtype=float)
    logs[1:] *= np.log2(logs[1:])
    base = of << 8

    def spread(channel: np.ndarray) -> np.ndarray:
        return logs[size] - logs[np.bincount(base | channel, minlength=k << 8)].reshape(k, 256).sum(axis=1)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, minlength=k)

    own = spread(green)
    least = spread(red) + own + spread(blue)
    keys = np.sort(of << 24 | red.astype(np.int64) << 16 | green.astype(np.int64) << 8 | blue)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    met, colour_of = np.diff(np.append(first, len(keys))), keys[first] >> 24
    colours = np.bincount(colour_of, minlength=k)
    palette = logs[size] - np.bincount(colour_of, logs[met], minlength=k) + 24 * colours
    palette[colours > 256] = np.inf
    wide = -(-width >> BLOCK_BITS)
    blocks = wide * -(-(size // width) >> BLOCK_BITS)
    block = (np.cumsum(blocks) - blocks)[of] + (at // width >> BLOCK_BITS) * wide + (at % width >> BLOCK_BITS)
    left, costs = [], []
    for back in (width, width - 1, width + 1):
        rest, cost, own_text = [], np.zeros(len(of), dtype=np.uint16), (at[back:] >= back).astype(np.uint8)
        for channel in (red, green, blue):
            x = channel.copy()
            x[back:] -= channel[: max(0, len(channel) - back)] * own_text
            cost += np.minimum(x, -x)
            rest.append(x)
        left.append(rest)
        costs.append(np.bincount(block, cost, minlength=int(blocks.sum())))
    best = np.argmin(costs, axis=0)[block]
    foretold = sum(spread(np.where(best == 0, x, np.where(best == 1, y, z))) for x, y, z in zip(*left)) + 4 * blocks + 64
    plain = own + spread(red - green) + spread(blue - green)
    r, g, b = (c.view(np.int8).astype(np.int64) for c in (red, green, blue))
    square, crossed = np.maximum(1.0, total(g * g)), own + 80
    for channel, signed in ((red, r), (blue, b)):
        times = np.clip(np.rint(32 * total(g * signed) / square), -128, 127).astype(np.int64)
        crossed = crossed + spread(channel - (times[of] * g >> 5).astype(np.uint8))
    return np.minimum(np.minimum(palette, foretold), np.minimum(plain, crossed)) < least + 1e-3


def encode_many(texts: list[bytes]) -> list[bytes]:
    """``encode`` of many texts, their codes worked out together."""
    images = [_laid(samples) for samples in texts]
    alike = [k for k, (_, width, _) in enumerate(images) if width == ROW_BYTES // 3]
    helped = np.ones(len(texts), dtype=bool)
    if alike:
        for lo, hi in _parts(np.array([len(images[k][0]) for k in alike]), _WRITTEN):
            helped[alike[lo:hi]] = _helped([images[k][0] for k in alike[lo:hi]], ROW_BYTES // 3)
    begun = [_begun(*image, may) for image, may in zip(images, helped.tolist())]
    codes = _codes([c for _, plan in begun for c in plan[0]])
    files = []
    for k, (out, plan) in enumerate(begun):
        _put_planned(out, plan, codes[5 * k : 5 * k + 5])
        body = b"\x2f" + out.data()
        body += b"\0" * (len(body) & 1)
        files.append(b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    return files


def encode(samples: bytes) -> bytes:
    """A lossless WebP file of bytes in threes, R, G, B; short of a whole image, blanks fill it.

    A palette is used where so few colours take fewer bits; else the predictor by blocks, then subtract-green or
    cross-colour, each where it leaves less entropy. What is left is written as back-references, colour cache and literals in one group of optimal prefix codes.
    """
    return encode_many([samples])[0]


def _laid(samples: bytes) -> tuple[np.ndarray, int, int]:
    """Bytes as pixels A, R, G, B, with their width and height."""
    rows = max(1, -(-len(samples) // ROW_BYTES))
    width = ROW_BYTES // 3 if rows <= MOST else MOST
    height = -(-len(samples) // (3 * width)) or 1
    if height > MOST:
        raise ValueError("a text of over 805 million bytes needs several images")
    flat = np.frombuffer(samples.ljust(3 * width * height, b" "), dtype=np.uint8).reshape(-1, 3)
    pixels = np.full((len(flat), 4), 255, dtype=np.uint8)
    pixels[:, 1:] = flat
    return pixels, width, height


def _begun(pixels: np.ndarray, width: int, height: int, helped: bool) -> tuple[Writer, tuple]:
    """What stands before the pixels of a file, and the plan of those."""
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)  # no alpha, version 0
    left = _put_transforms(out, pixels, width, height) if helped else pixels
    out.put(0, 1)  # no more transforms
    return out, _planned(left, True)


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b" ")


def feature(pixels: np.ndarray) -> str:
    """Size, sums of the channels, and the sum of steps between neighbours in a row."""
    rgb = pixels[:, :, 1:].astype(np.int16)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:" + ":".join(map(str, rgb.sum(axis=(0, 1), dtype=np.int64))) + f":{np.abs(np.diff(rgb, axis=1)).sum(dtype=np.int64)}"


MEDIA = T.StructType(
    [T.StructField("media", T.BinaryType())]
    + [T.StructField(n, T.LongType()) for n in ("n_bytes", "payload_bytes")]
    + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("media_sha256", "feature")]
)


def _store(texts: list[bytes]) -> list[tuple]:
    """Media and what is read back of each text; those that are equal are stored once."""
    own, found = list(dict.fromkeys(texts)), {}
    stored = encode_many([pad(data) for data in own])
    for data, media, pixels in zip(own, stored, decode_many(stored)):
        back = pixels[:, :, 1:].tobytes()[: len(pad(data))]
        found[data] = media, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)
    return [found[data] for data in texts]


def _parts(sizes: np.ndarray, most: int = TOGETHER_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts to take together: TOGETHER at most, and ``most`` in size or one."""
    lo, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > lo and (k - lo >= TOGETHER or held + size > most):
            yield lo, k
            lo, held = k, 0
        held += size
    if len(sizes):
        yield lo, len(sizes)


def _stored(text: str, keep_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rest = [i for i, n in enumerate(batch.schema.names) if n != text and n not in MEDIA.names]
            texts = batch.column(at).cast(pa.large_binary())
            for lo, hi in _parts(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False))):  # stored bytes leave some texts at a time
                part = batch.slice(lo, hi - lo)
                made = _store([x.as_py() or b"" for x in texts.slice(lo, hi - lo)])
                columns = [pa.array([m[k] for m in made]) for k in range(len(MEDIA.names))]
                first = 0 if keep_media else 1
                yield pa.RecordBatch.from_arrays([part.column(i) for i in rest] + columns[first:], names=[batch.schema.names[i] for i in rest] + MEDIA.names[first:])

    return run


def media_columns(docs: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """``docs`` with ``text`` stored as lossless WebP in column media, and what is read back from those bytes.

    A null text is an empty one; its payload is 192 blanks. Equal texts give equal values; repeated rows stay. Columns
    named as a new one are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in MEDIA.names]
    return docs.mapInArrow(_stored(text, keep_media), T.StructType(kept + MEDIA.fields[0 if keep_media else 1 :]))


def op7(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_media=False)
