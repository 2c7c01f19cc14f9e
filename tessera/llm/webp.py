"""Lossless WebP: a full decoder, an encoder for byte payloads, and media columns.

The decoder reads the whole lossless format: prefix codes, meta prefix groups,
back-references with the neighbour distance map, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms.  Images with one
prefix group and no cache are decoded by tables over all bit positions of a
segment: the length of the pixel that would start there, which a walk then hops
along, copying back-references as slices.  Others are read pixel by pixel.

The encoder lays a payload as grey pixels, one a byte, and writes them as a palette
(packed several to a pixel where it is small) or, where that is smaller by the
entropy of the residuals, with the predictor and cross-colour transforms; repeats
of eight pixels and more become back-references, and prefix codes have the lengths
that the counts ask for.  The colour cache never shrinks an image of one channel,
so the encoder does not use it.

Defined results: null text is the empty text (one row of spaces); equal texts
give equal files, repeated rows repeated results; texts of any length are stored
whole (wider images, beyond 255 MB several frames); an empty table gives an empty
result; only `keep` columns are carried, and a made column wins over a kept one of
the same name; a null media value reads as nulls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.frames import arrow_map
from tessera.llm.textops import U64, as_binary, mix64, slices

#: Order in which the lengths of the code-length code are stored (fixed values of the format).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ROW, MAX_SIDE = 192, 16384
#: Repeats of fewer pixels are written out; longest back-reference and prefix code (of the format, of this encoder).
LEAST_COPY, MOST_COPY, MOST_BITS = 8, 4096, 12
#: Bytes of a stream that are tabled at once, and bits in which several literals are found at once.
SEGMENT, HOP_BITS = 1 << 16, 11
#: Bits at a stream's end before which a file of this encoder has no padding.
TAIL_BITS = 96
#: Short distances name neighbours, nearest first, by how far they lie to the side and then left before right.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.total = 8 * len(data)

    def read(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        if at + n > self.total:
            raise ValueError("the stream ends early")
        first = at >> 3
        word = int.from_bytes(self.data[first : (at + n + 7) >> 3], "little")
        self.at = at + n
        return word >> (at & 7) & ((1 << n) - 1)

    def peek(self) -> int:
        """The bits ahead, at least 57, with zeros beyond the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.total:
            raise ValueError("the stream ends early")


@lru_cache(maxsize=16)
def mirrored(width: int) -> np.ndarray:
    """Each number of `width` bits with its bits in the opposite order."""
    x = np.arange(1 << width)
    out = np.zeros_like(x)
    for i in range(width):
        out = out << 1 | x >> i & 1
    return out


class Prefix:
    """A canonical prefix code, as a table over the next `width` bits: symbol << 4 | size of the code they begin with."""

    def __init__(self, lengths: bytes):
        given = np.frombuffer(lengths, dtype=np.uint8)
        used = np.flatnonzero(given)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        sizes = given[used] if len(used) > 1 else np.zeros(1, np.uint8)  # one symbol takes no bits
        by_size = np.argsort(sizes, kind="stable")
        symbols, sizes = used[by_size], sizes[by_size]
        self.width = int(sizes[-1])
        share = np.int64(1) << (self.width - sizes.astype(np.int64))
        if int(share.sum()) != 1 << self.width:
            raise ValueError("a prefix code that is not complete")
        # codes of one size follow one another, the first bit read being the highest
        self.table = np.repeat((symbols << 4 | sizes).astype(np.uint16), share)[mirrored(self.width)]
        self.mask, self.only = (1 << self.width) - 1, int(symbols[0])
        self.hop: tuple[np.ndarray, ...] | None = None

    def listed(self) -> memoryview:
        """The table, giving Python's own numbers; a list would be copied for each of the many codes that few pixels use."""
        return memoryview(self.table)

    def hops(self) -> tuple[np.ndarray, ...]:
        """Over the next HOP_BITS bits: bits | count << 4 of the literals (up to three) that lie in them whole, and those literals.

        0 where the first is none, or is longer than that.
        """
        if self.hop is None:
            index = np.arange(1 << HOP_BITS)
            one = np.tile(self.table, max(1, len(index) >> self.width))[: len(index)].astype(np.int64)
            # a code that is no literal takes more bits than there are
            size = np.where(one < 4096, one & 15, HOP_BITS + 1)
            literal = (one >> 4).astype(np.uint8)
            spent, open_ = size, size <= HOP_BITS
            hop, literals = np.where(open_, size | 16, 0), [literal]
            for count in (2, 3):
                ahead = index >> np.minimum(spent, HOP_BITS)
                spent = spent + size[ahead]
                open_ = spent <= HOP_BITS
                literals.append(literal[ahead])
                hop = np.where(open_, spent | count << 4, hop)
            self.hop = (hop.astype(np.uint8), *literals)
        return self.hop

    def read(self, bits: Bits) -> int:
        if not self.width:
            return self.only
        found = int(self.table[bits.peek() & self.mask])
        bits.skip(found & 15)
        return found >> 4


@lru_cache(maxsize=2048)
def prefix(lengths: bytes) -> Prefix:
    """The code of given lengths, zeros at the end left out; files of like texts share many."""
    return Prefix(lengths)


@lru_cache(maxsize=2048)
def simple(one: int, other: int) -> Prefix:
    """The code of one symbol or of two."""
    lengths = bytearray(max(one, other) + 1)
    lengths[one] = lengths[other] = 1
    return prefix(bytes(lengths))


def read_prefix(bits: Bits, size: int) -> Prefix:
    word = bits.peek()
    if word & 1:
        at, mask = (11, 255) if word & 4 else (4, 1)
        if word & 2:
            bits.skip(at + 8)
            return simple(word >> 3 & mask, word >> at & 255)
        bits.skip(at)
        return simple(word >> 3 & mask, word >> 3 & mask)
    bits.skip(1)
    first = bytearray(19)
    given = 4 + bits.read(4)
    word = bits.read(3 * given)
    for s in CODE_LENGTH_ORDER[:given]:
        first[s] = word & 7
        word >>= 3
    outer = prefix(bytes(first).rstrip(b"\0"))
    table, mask = outer.listed(), outer.mask
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    start = bits.at
    word = int.from_bytes(bits.data[start >> 3 : (start >> 3) + 2 + 2 * min(left, size)], "little") >> (start & 7)
    lengths, before, spent = bytearray(), 8, 0
    while len(lengths) < size and left:
        left -= 1
        found = table[word & mask]
        n, step = found >> 4, found & 15
        word >>= step
        if n < 16:
            lengths.append(n)
            before = n or before
        else:
            extra = (2, 3, 7)[n - 16]
            lengths += bytes((before if n == 16 else 0,)) * ((3, 3, 11)[n - 16] + (word & ((1 << extra) - 1)))
            word >>= extra
            step += extra
        spent += step
    if len(lengths) > size:
        raise ValueError("code lengths run over the alphabet")
    bits.skip(spent)
    return prefix(bytes(lengths).rstrip(b"\0"))


def _spelt(code: int, word: int) -> tuple[int, int]:
    """A length's or distance's value, and the number of extra bits it takes from the word."""
    if code < 4:
        return code + 1, 0
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + (word & ((1 << extra) - 1)) + 1, extra


def _extended(bits: Bits, code: int) -> int:
    value, extra = _spelt(code, bits.peek())
    bits.skip(extra)
    return value


def _sub_size(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as unsigned 32-bit ARGB, before inverse transforms."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_of, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups_of = read_image(bits, _sub_size(width, tile), _sub_size(height, tile), False) >> 8 & 0xFFFF
    count = int(groups_of.max()) + 1 if groups_of is not None else 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    groups = [[read_prefix(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(count)]
    total = width * height
    if count == 1 and not cache_size:
        return _walk(bits, width, groups[0], total)
    out: list[int] = []
    cache, kept = [0] * cache_size, 0
    shift = 32 - cache_bits
    while len(out) < total:
        at = len(out)
        group = groups[0] if groups_of is None else groups[int(groups_of[(at // width >> tile) * _sub_size(width, tile) + (at % width >> tile)])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _extended(bits, s - 256)
            far = _far(bits, group[4], width)
            if far > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-far])
        else:
            for c in out[kept:]:
                cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> shift] = c
            kept = len(out)
            out.append(cache[s - 280])
    return np.array(out, dtype=np.uint32)


def _pixels_back(far: int, width: int) -> int:
    """A distance in pixels: short ones name neighbours."""
    if far > 120:
        return far - 120
    x, y = NEIGHBOURS[far - 1]
    return max(1, x + y * width)


def _far(bits: Bits, code: Prefix, width: int) -> int:
    """How many pixels back a reference goes."""
    return _pixels_back(_extended(bits, code.read(bits)), width)


def _walk(bits: Bits, width: int, group: list[Prefix], total: int) -> np.ndarray:
    """Pixels of one prefix group without a cache."""
    green, *others = group[:4]
    if any(c.width for c in others):
        return _walk_pixels(bits, width, group, total)
    red, blue, alpha = (c.only for c in others)
    rest = np.uint32(alpha << 24 | red << 16 | blue)
    if not green.width:
        if green.only >= 256:
            raise ValueError("a back-reference leaves the image")
        return np.full(total, rest | np.uint32(green.only << 8), dtype=np.uint32)
    return _walk_green(bits, width, green, group[4], total).astype(np.uint32) << np.uint32(8) | rest


def _reference(data: bytes, after: int, code: int, apart: memoryview, mask: int, width: int) -> tuple[int, int, int]:
    """Length and distance in pixels of a back-reference, and the bits they take behind the length's code: at most 43."""
    word = int.from_bytes(data[after >> 3 : (after >> 3) + 8], "little") >> (after & 7)
    if code < 4:
        length, spent = code + 1, 0
    else:
        spent = (code - 2) >> 1
        length = ((2 + (code & 1)) << spent) + (word & ((1 << spent) - 1)) + 1
    found = apart[word >> spent & mask]
    spent += found & 15
    found >>= 4
    if found < 4:
        return length, _pixels_back(found + 1, width), spent
    extra = (found - 2) >> 1
    far = ((2 + (found & 1)) << extra) + (word >> spent & ((1 << extra) - 1)) + 1
    return length, far - 120 if far > 120 else _pixels_back(far, width), spent + extra


def _walk_far(data: bytes, base: int, at: int, near: int, jump: bytes, window: np.ndarray, width: int, green: Prefix, distance: Prefix) -> tuple[int, list[int], list[tuple[int, int, int]]]:
    """From bit `at` behind `base` to the first place at or beyond `near`: that place, the places of literals (~place of a lone one)
    and the back-references (how many places came before, length, distance).

    jump: bits of the literals whole in the next HOP_BITS bits, 0 from `near` on.
    """
    starts: list[int] = []
    references: list[tuple[int, int, int]] = []
    add, single, mask = starts.append, green.listed(), green.mask
    apart, far_mask = distance.listed(), distance.mask
    while at < near:
        while n := jump[at]:  # zeros follow the last
            add(at)
            at += n
        if at >= near:
            break
        found = int(window[at])
        found = single[found & mask]
        if found < 4096:
            add(~at)
            at += found & 15
            continue
        after = base + at + (found & 15)
        length, far, spent = _reference(data, after, (found >> 4) - 256, apart, far_mask, width)
        references.append((len(starts), length, far))
        at = after + spent - base
    return at, starts, references


def _counted(places: np.ndarray, step: np.ndarray, window: np.ndarray) -> np.ndarray:
    """How many literals begin in the bits at each place; one at a place given as ~place."""
    count = step[window[np.maximum(places, 0)] & np.uint16((1 << HOP_BITS) - 1)] >> np.uint8(4)
    count[places < 0] = 1
    return count


def _walk_green(bits: Bits, width: int, green: Prefix, distance: Prefix, total: int) -> np.ndarray:
    """The green values of pixels whose other channels are constant: a walk from literals to literals over tabled bit positions."""
    out, done = bytearray(total), 0
    step, *literals = green.hops()
    jump = step & np.uint8(15)
    single, apart = green.listed(), distance.listed()
    while done < total:
        base = bits.at >> 3
        raw = np.frombuffer(bits.data[base : base + SEGMENT + 32] + bytes(64), np.uint8).astype(np.uint32)
        three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        window = (three[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).reshape(-1)
        limit = 8 * min(SEGMENT, len(raw) - 48)
        ahead = window[:limit] & np.uint16((1 << HOP_BITS) - 1)
        at, starts, runs, begun, room = bits.at & 7, [], [], done, total - done
        known, count = [], []  # of all places passed
        # far from the stream's end pixels need no counting on the way
        near = min(limit, bits.total - 8 * base - TAIL_BITS)
        if near > 0:
            swift = _walk_far(bits.data, 8 * base, at, near, jump[ahead[:near]].tobytes() + bytes(HOP_BITS), window, width, green, distance)
            places = np.array(swift[1], dtype=np.int64)
            counts = _counted(places, step, window)
            after = np.zeros(len(counts) + 1, dtype=np.int64)
            np.cumsum(counts, out=after[1:])
            read = int(after[-1])
            copied = sum([n for _, n, _ in swift[2]])
            if read + copied <= room:  # else the image ends before: pixels are counted
                at = swift[0]
                known.append(places)
                count.append(counts)
                room -= read + copied
                to, past = done, 0
                for literal, (_, length, far) in zip(after[[i for i, *_ in swift[2]]].tolist() if swift[2] else (), swift[2], strict=True):
                    to += literal - past
                    if far > to:
                        raise ValueError("a back-reference leaves the image")
                    runs.append((literal - past, length, far))
                    past = literal
                    to += length
                runs.append((read - past, 0, 0))
        begin, add = at, starts.append  # places before are not looked at again
        hops = step[ahead[begin:]].tobytes()
        while room:
            before = room
            if at < limit:
                while room > 2:
                    n = hops[at - begin]
                    if not n:
                        break
                    add(at)
                    at += n & 15
                    room -= n >> 4
                    if at >= limit:
                        break
            if at >= limit or not room:
                runs.append((before - room, 0, 0))
                break
            found = single[int(window[at]) & green.mask]
            if found < 4096:  # one literal
                add(~at)
                at += found & 15
                room -= 1
                runs.append((before - room, 0, 0))
                continue
            after = 8 * base + at + (found & 15)
            length, far, spent = _reference(bits.data, after, (found >> 4) - 256, apart, distance.mask, width)
            to = total - room
            if far > to or length > room:
                raise ValueError("a back-reference leaves the image")
            runs.append((before - room, length, far))
            room -= length
            at = after + spent - 8 * base
        done = total - room
        bits.at = 8 * base + at
        if bits.at > bits.total:
            raise ValueError("the stream ends early")
        places = np.array(starts, dtype=np.int64)
        known, count = np.concatenate([*known, places]), np.concatenate([*count, _counted(places, step, window)])
        many = known >= 0
        code = window[np.where(many, known, ~known)]
        index = code & np.uint16((1 << HOP_BITS) - 1)
        end = np.cumsum(count, dtype=np.int64)
        place = end - count
        found = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
        found[place] = literals[0][index]
        lone = np.flatnonzero(~many)
        found[place[lone]] = green.table[code[lone] & np.uint16(green.mask)] >> np.uint16(4)
        for k in (1, 2):
            some = np.flatnonzero(count > k)
            found[place[some] + k] = literals[k][index[some]]
        to, taken, found = begun, 0, found.tobytes()
        for literal, length, far in runs:
            out[to : to + literal] = found[taken : taken + literal]
            to, taken = to + literal, taken + literal
            if far >= length:
                out[to : to + length] = out[to - far : to - far + length]
            elif length:
                out[to : to + length] = (out[to - far : to] * (length // far + 1))[:length]
            to += length
    return np.frombuffer(out, dtype=np.uint8)


def _walk_pixels(bits: Bits, width: int, group: list[Prefix], total: int) -> np.ndarray:
    """Pixels read channel by channel."""
    (g, gm), (r, rm), (b, bm), (a, am) = ((c.listed(), c.mask) for c in group[:4])
    out: list[int] = []
    word, left = 0, 0  # bits read ahead
    while len(out) < total:
        if left < 60:
            bits.at -= left
            word, left = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 40], "little") >> (bits.at & 7), 312
            bits.at += left
        found = g[word & gm]
        n = found & 15
        if found >= 4096:
            bits.at += n - left
            length = _extended(bits, (found >> 4) - 256)
            far = _far(bits, group[4], width)
            if far > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-far])
            left = 0
            continue
        x = r[word >> n & rm]
        n += x & 15
        y = b[word >> n & bm]
        n += y & 15
        z = a[word >> n & am]
        n += z & 15
        out.append(z >> 4 << 24 | x >> 4 << 16 | found >> 4 << 8 | y >> 4)
        word >>= n
        left -= n
    bits.at -= left
    if bits.at > bits.total:
        raise ValueError("the stream ends early")
    return np.array(out, dtype=np.uint32)


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _each(f, *pixels: int) -> int:
    out = 0
    for shift in (24, 16, 8, 0):
        out |= (f(*((p >> shift) & 255 for p in pixels)) & 255) << shift
    return out


def _average(a: int, b: int) -> int:
    return _each(lambda x, y: (x + y) >> 1, a, b)


def _clip(v: int) -> int:
    return min(max(v, 0), 255)


def _select(left: int, top: int, corner: int) -> int:
    near = lambda other: sum(abs(((other >> s) & 255) - ((corner >> s) & 255)) for s in (24, 16, 8, 0))
    return left if near(top) < near(left) else top


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predicted pixel; `right` is above to the right, `corner` above to the left."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(corner if mode == 8 else top, top if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _each(lambda a, b, c: _clip(a + b - c), left, top, corner)
    return _each(lambda a, c: _clip(a + int((a - c) / 2)), _average(left, top), corner)


def undo_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    mode = modes >> 8 & 15
    if len(mode) and mode.min() == mode.max() and mode[0] in (1, 2):  # running sums along rows or columns
        grid = pixels.astype("<u4").view(np.uint8).reshape(height, width, 4).copy()
        grid[0, 0, 3] = (int(grid[0, 0, 3]) + 255) & 255
        if mode[0] == 1:
            grid[:, 0] = np.cumsum(grid[:, 0], axis=0, dtype=np.uint8)
            grid = np.cumsum(grid, axis=1, dtype=np.uint8)
        else:
            grid[0] = np.cumsum(grid[0], axis=0, dtype=np.uint8)
            grid = np.cumsum(grid, axis=0, dtype=np.uint8)
        return np.ascontiguousarray(grid).view("<u4").reshape(-1).astype(np.uint32)
    out, across = pixels.tolist(), _sub_size(width, bits)
    add = lambda a, b: ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)
    for at in range(width * height):
        y, x = divmod(at, width)
        if not at:
            guess = 0xFF000000
        elif not y:
            guess = out[at - 1]
        elif not x:
            guess = out[at - width]
        else:
            mode = int(modes[(y >> bits) * across + (x >> bits)]) >> 8 & 15
            guess = predict(mode, out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
        out[at] = add(out[at], guess)
    return np.array(out, dtype=np.uint32)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, factors: np.ndarray) -> np.ndarray:
    across = _sub_size(width, bits)
    at = np.arange(width * height)
    f = factors[(at // width >> bits) * across + (at % width >> bits)]
    byte = lambda v, s: ((v >> s) & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = byte(pixels, 8)
    red = ((pixels >> 16) & 255).astype(np.int32) + (byte(f, 0) * green >> 5) & 255
    blue = ((pixels & 255).astype(np.int32) + (byte(f, 8) * green >> 5)) & 255
    blue = (blue + (byte(f, 16) * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    if not (pixels & np.uint32(0x00FF00FF)).any():
        return pixels | green << np.uint32(16) | green
    return (pixels & np.uint32(0xFF00FF00)) | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)


def undo_palette(pixels: np.ndarray, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    """Indices, several to a pixel's green where the palette is small; an index beyond the palette is transparent black."""
    packed, per = _sub_size(width, bits), 8 >> bits
    if not bits and len(table) <= 256:
        full = np.zeros(256, dtype=np.uint32)
        full[: len(table)] = table
        return full[pixels >> np.uint32(8) & np.uint32(255)]
    x = np.arange(width)
    green = (pixels.reshape(height, packed) >> 8 & 255)[:, x >> bits]
    index = green >> (per * (x & ((1 << bits) - 1))).astype(np.uint32) & np.uint32((1 << per) - 1)
    full = np.zeros(256, dtype=np.uint32)
    full[: len(table)] = table
    return full[index].reshape(-1)


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixel array (height, width, 4) of R, G, B, A from a lossless bitstream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, across, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            block = read_image(bits, _sub_size(across, size), _sub_size(height, size), False)
            undo.append((undo_cross_colour if kind else undo_predictor, (across, height, size, block)))
        elif kind == 2:
            undo.append((undo_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            deltas = read_image(bits, n, 1, False)
            channels = [np.cumsum(deltas >> s & 255) & 255 for s in (24, 16, 8, 0)]
            table = np.bitwise_or.reduce([c.astype(np.uint32) << s for c, s in zip(channels, (24, 16, 8, 0), strict=True)])
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, (across, height, size, table)))
            across = _sub_size(across, size)
    pixels = read_image(bits, across, height, True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    pixels = pixels & np.uint32(0xFF00FF00) | pixels >> np.uint32(16) & np.uint32(255) | (pixels & np.uint32(255)) << np.uint32(16)
    return pixels.astype("<u4", copy=False).view(np.uint8).reshape(height, width, 4)


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def decode_file(data: bytes) -> np.ndarray:
    for kind, body in chunks(data):
        if kind == b"VP8L":
            return decode_vp8l(body)
    raise ValueError("no lossless image in the file")


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def array(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.size + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.size]


def code_lengths(counts: Sequence[int], most: int) -> list[int]:
    """Lengths of a complete prefix code, at most `most`, near the counts' information; 0 for symbols of no count."""
    out = [0] * len(counts)
    used = sorted([(-c, s) for s, c in enumerate(counts) if c])
    for (_, s), n in zip(used, _ranked_lengths([c for c, _ in used], most), strict=True):
        out[s] = n
    return out


def _ranked_lengths(used: list[int], most: int) -> list[int]:
    """Lengths of a complete prefix code of symbols with these counts, negative, the largest count first."""
    if len(used) < 2:
        return [1] * len(used)
    total = -sum(used)
    # the least n of at least 1 with count * 2**n >= total
    length = [n if (n := (-(total // c) - 1).bit_length() if total % c == 0 else (total // -c).bit_length()) < most else most for c in used]
    room = (1 << most) - sum([1 << (most - n) for n in length])
    at = len(length) - 1
    while room < 0:  # the limit has made codes too short: lengthen the rarest that can be
        while length[at] >= most:
            at -= 1
        length[at] += 1
        room += 1 << (most - length[at])
    while room:  # shorten the commonest that can be
        for i, n in enumerate(length):
            gain = 1 << (most - n)
            if gain <= room and n > 1:
                length[i] = n - 1
                room -= gain
                if not room:
                    break
    return length


@lru_cache(maxsize=16)
def mirror_list(width: int) -> list[int]:
    return mirrored(width).tolist()


def codes_of(lengths: Sequence[int]) -> list[int]:
    """Canonical codes, as they are written: the first bit lowest."""
    out = [0] * len(lengths)
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    top = order[-1][0]
    mirror, code = mirror_list(top), 0
    for n, s in order:
        out[s] = mirror[code]
        code += 1 << (top - n)
    return out


def _put_code(out: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for counted symbols; returns each symbol's written code and its number of bits."""
    used = np.flatnonzero(counts)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        few = used.tolist() or [0]
        codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        for i, s in enumerate(few):
            codes[s], sizes[s] = i, len(few) - 1
        out.put(1 | (len(few) - 1) << 1 | 1 << 2, 3)
        for s in few:
            out.put(s, 8)
        return codes, sizes
    ranked = sorted(zip((-counts[used]).tolist(), used.tolist(), strict=True))
    lengths = sorted(zip([s for _, s in ranked], _ranked_lengths([c for c, _ in ranked], MOST_BITS), strict=True))
    tokens, kinds, before = [], [0] * 19, -1
    for s, n in lengths:
        rest, before = s - before - 1, s
        while rest >= 3:
            run = min(rest, 138)
            tokens.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            kinds[tokens[-1][0]] += 1
            rest -= run
        if rest:
            tokens += [(0, 0, 0)] * rest
            kinds[0] += rest
        tokens.append((n, 0, 0))
        kinds[n] += 1
    outer = code_lengths(kinds, 7)
    code = codes_of(outer)
    size = outer if sum(map(bool, kinds)) > 1 else [0] * 19
    own = BitWriter()
    own.put(0, 1)
    wanted = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if outer[s]))
    own.put(wanted - 4, 4)
    for s in CODE_LENGTH_ORDER[:wanted]:
        own.put(outer[s], 3)
    # how many lengths are written; the others are 0
    many = len(tokens)
    room = next(k for k in range(8) if many - 2 < 1 << (2 + 2 * k))
    own.put(1 | room << 1 | (many - 2) << 4, 6 + 2 * room)
    value, at = own.value, own.size
    for n, extra, bits in tokens:
        value |= (code[n] | extra << size[n]) << at
        at += size[n] + bits
    out.put(value, at)
    codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    size = [n for _, n in lengths]
    codes[used] = codes_of(size)
    if len(used) > 1:
        sizes[used] = size
    return codes, sizes


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances."""
    tables = _prefix_tables()
    if len(values) and int(values.max()) >= len(tables[0]):
        return _prefixes(values)
    return tuple(t[values] for t in tables)


@lru_cache(maxsize=1)
def _prefix_tables() -> tuple[np.ndarray, ...]:
    return _prefixes(np.arange(1 << 16))


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.maximum(values - 1, 0)
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), x & ((np.int64(1) << extra) - 1), extra


def copies(pixels: np.ndarray) -> np.ndarray:
    """Back-references (place, length, distance): runs that repeat what stands at the latest place with the same eight pixels."""
    if len(pixels) <= LEAST_COPY:
        return np.zeros((0, 3), np.int64)
    x = pixels.astype(U64)
    for wide in (1, 2, 4):
        x = x[:-wide] | x[wide:] << U64(8 * wide)
    if len(x) <= 1 << 16:  # hashes that end in the places sort fast, and in the order of places; equal hashes are compared
        low = U64((1 << 16) - 1)
        order = (np.sort((mix64(x) & ~low) | np.arange(len(x), dtype=U64)) & low).astype(np.int64)
    else:
        order = np.argsort(x, kind="stable")
    ranked = x[order]
    twin = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(twin):
        return np.zeros((0, 3), np.int64)
    far = np.zeros(len(x), dtype=np.int64)
    far[order[twin + 1]] = order[twin + 1] - order[twin]
    change = np.empty(len(far) + 1, dtype=bool)  # runs of one distance
    change[0], change[-1] = far[0] != 0, far[-1] != 0
    np.not_equal(far[1:], far[:-1], out=change[1:-1])
    edge = np.flatnonzero(change)
    runs = np.flatnonzero(far[edge[:-1]])
    out, done = [], 0
    for a, z, d in zip(edge[runs].tolist(), edge[runs + 1].tolist(), far[edge[runs]].tolist(), strict=True):
        end = z - 1 + LEAST_COPY
        at = max(a, done)
        if end - at < LEAST_COPY:
            continue
        while end - at >= LEAST_COPY:
            n = min(end - at, MOST_COPY)
            out.append((at, n, d))
            at += n
        done = at
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _joined(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fields of 1 to 31 bits one after another, as 32-bit words."""
    values, sizes = values[sizes > 0], sizes[sizes > 0]
    if not len(values):
        return np.zeros(0, np.uint32)
    start = np.cumsum(sizes) - sizes
    placed = values.astype(U64) << (start & 31).astype(U64)
    word = start >> 5
    new = np.ones(len(word), dtype=bool)
    np.not_equal(word[1:], word[:-1], out=new[1:])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(placed, first)
    out = np.zeros(int(word[-1]) + 2, dtype=U64)
    out[word[first]] = sums & U64(0xFFFFFFFF)
    out[word[first] + 1] |= sums >> U64(32)
    return out.astype("<u4")


def _put_pixels(out: BitWriter, green: np.ndarray, others: Sequence[int], main: bool) -> np.ndarray:
    """Writes the codes of an image whose red, blue and alpha are constant; returns its pixels' bits as words."""
    found = copies(green)
    edge = np.zeros(len(green) + 1, dtype=np.int32)
    edge[found[:, 0]] += 1
    edge[found[:, 0] + found[:, 1]] -= 1
    place = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    length, length_extra, length_bits = _prefixed(found[:, 1])
    far, far_extra, far_bits = _prefixed(found[:, 2] + 120)
    literal = green[place].astype(np.int64)
    out.put(0, 2 if main else 1)  # no cache, one prefix group
    counts = np.bincount(literal, minlength=280)
    counts[256:] = np.bincount(length, minlength=24)
    code, size = _put_code(out, counts)
    for value in others:
        out.put(1 | 1 << 2 | value << 3, 11)
    far_code, far_size = _put_code(out, np.bincount(far, minlength=40))
    if not len(found):
        return _joined(code[literal], size[literal])
    # four fields of a back-reference lie before the literals that follow it
    at = np.searchsorted(place, found[:, 0]) + 4 * np.arange(len(found))
    fields, bits = np.empty((2, len(literal) + 4 * len(found)), dtype=np.int64)
    free = np.ones(len(fields), dtype=bool)
    made = ((code[256 + length], size[256 + length]), (length_extra, length_bits), (far_code[far], far_size[far]), (far_extra, far_bits))
    for k, (value, width) in enumerate(made):
        fields[at + k], bits[at + k], free[at + k] = value, width, False
    fields[free], bits[free] = code[literal], size[literal]
    return _joined(fields, bits)


def _inline(out: BitWriter, words: np.ndarray, used: int) -> None:
    out.put(int.from_bytes(words.tobytes(), "little") & ((1 << used) - 1), used)


def _put_constant(out: BitWriter, pixel: int) -> None:
    """An image that is the same pixel everywhere."""
    out.put(0, 1)
    for shift in (8, 16, 0, 24):
        out.put(1 | 1 << 2 | (pixel >> shift & 255) << 3, 11)
    out.put(1, 4)


def _entropy(values: np.ndarray) -> float:
    return _information(np.bincount(values.reshape(-1), minlength=256), values.size)


def _information(counts: np.ndarray, total: int) -> float:
    c = counts[counts > 0].astype(np.float64)
    return float(np.log2(total) - np.dot(c, np.log2(c)) / total)


def encode_vp8l(grey: np.ndarray) -> bytes:
    """A lossless bitstream of an opaque grey image (height, width)."""
    height, width = grey.shape
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1 | (height - 1) << 14, 28)
    out.put(0, 4)  # opaque, version 0
    left, top = grey.copy(), grey.copy()
    left[:, 1:] -= grey[:, :-1]
    left[1:, 0] -= grey[:-1, 0]
    top[1:] -= grey[:-1]
    top[0, 1:] -= grey[0, :-1]
    guesses = {1: _entropy(left), 2: _entropy(top)}
    mode = min(guesses, key=guesses.get)
    counts = np.bincount(grey.reshape(-1), minlength=256)
    if guesses[mode] < 0.9 * _information(counts, grey.size):
        # the residuals' alpha is 0, and a cross-colour factor of one (32) takes green from red and blue
        for kind, pixel in ((0, mode << 8), (1, 32 << 8 | 32)):
            out.put(1 | kind << 1 | 7 << 3, 6)  # tiles of 512 pixels
            _put_constant(out, pixel)
        out.put(0, 1)
        words = _put_pixels(out, (left if mode == 1 else top).reshape(-1), (0, 0, 0), True)
    else:
        present = counts > 0
        colours = np.flatnonzero(present)
        n = len(colours)
        out.put(1 | 2 << 1, 3)  # green is taken from red and blue, so that the palette has it alone
        out.put(1 | 3 << 1, 3)
        out.put(n - 1, 8)
        # the palette, one row: differences of green, then alpha 255 once and 0
        step = colours.copy()
        step[1:] -= colours[:-1]
        out.put(0, 1)
        green, size = _put_code(out, np.bincount(step, minlength=256))
        for _ in range(2):
            out.put(1 | 1 << 2, 11)
        if n > 1:  # 0 and 255: one bit each
            out.put(1 | 1 << 1 | 1 << 2 | 255 << 11, 19)
        else:
            out.put(1 | 1 << 2 | 255 << 3, 11)
        out.put(1, 4)
        one, one_size = green[step], size[step] + (n > 1)
        one[0] |= (n > 1) << int(size[step[0]])
        _inline(out, _joined(one, one_size), int(one_size.sum()))
        index = (np.cumsum(present) - 1).astype(np.uint8)[grey]
        small = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        if small:
            per = 8 >> small
            packed = np.zeros((height, _sub_size(width, small)), dtype=np.uint8)
            for k in range(1 << small):
                some = index[:, k :: 1 << small]
                packed[:, : some.shape[1]] |= some << np.uint8(k * per)
            index = packed
        out.put(0, 1)
        words = _put_pixels(out, index.reshape(-1), (0, 0, 255), True)
    # the header's last bits and the pixels' words in one stream
    head, shift = out.value, out.size & 31
    body = np.zeros(out.size // 32 + len(words) + 1, dtype=U64)
    body[: out.size // 32 + 1] = np.frombuffer(head.to_bytes(4 * (out.size // 32 + 1), "little"), "<u4")
    moved = words.astype(U64) << U64(shift)
    body[out.size // 32 : out.size // 32 + len(words)] |= moved & U64(0xFFFFFFFF)
    body[out.size // 32 + 1 :] |= moved >> U64(32)
    return body.astype("<u4").tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _image(payload: bytes) -> tuple[bytes, int, int]:
    """A lossless chunk of a payload, the last row filled up with zeros, and its width and height."""
    width = ROW * -(-len(payload) // (ROW * MAX_SIDE))
    grey = np.frombuffer(payload + b"\0" * (-len(payload) % width), np.uint8).reshape(-1, width)
    return _chunk(b"VP8L", encode_vp8l(grey)), width, grey.shape[0]


def store(payload: bytes, most: int = ROW * (MAX_SIDE // ROW) * MAX_SIDE) -> bytes:
    """A WebP file of a payload that is a positive multiple of 192 bytes.

    Rows are 192 grey pixels, or a multiple where the image would grow too high;
    then the last row may be filled up, and a chunk of the extended format keeps
    the payload's length.  A payload beyond one image's `most` bytes becomes frames.
    """
    if not payload or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    images = [_image(payload[at : at + most]) for at in range(0, len(payload), most)]
    body, (_, width, height) = images[0][0], images[0]
    three = lambda v: v.to_bytes(3, "little")
    if len(images) > 1 or width * height != len(payload):
        canvas = three(max(w for _, w, _ in images) - 1) + three(max(h for *_, h in images) - 1)
        if len(images) > 1:
            body = _chunk(b"ANIM", struct.pack("<IH", 0, 0)) + b"".join(_chunk(b"ANMF", bytes(6) + three(w - 1) + three(h - 1) + three(100) + b"\2" + image) for image, w, h in images)
        body = _chunk(b"VP8X", struct.pack("<I", 2 * (len(images) > 1)) + canvas) + body + _chunk(b"PLEN", struct.pack("<Q", len(payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def load(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload read back, and the pixel arrays it was read from."""
    images, size = [], None
    for kind, body in chunks(media):
        if kind == b"VP8L":
            images.append(decode_vp8l(body))
        elif kind == b"ANMF":
            images.append(decode_vp8l(body[24 : 24 + int.from_bytes(body[20:24], "little")]))
        elif kind == b"PLEN":
            size = struct.unpack("<Q", body)[0]
    return b"".join(x[:, :, 1].tobytes() for x in images)[:size], images


def features(images: Sequence[np.ndarray]) -> str:
    """Width and height of each image, then mean and distinct values of R, G and B over all."""
    sides = "+".join(f"{x.shape[1]}x{x.shape[0]}" for x in images)
    counts = [sum(np.bincount(x[:, :, c].reshape(-1), minlength=256) for x in images) for c in range(3)]
    return sides + ";" + ";".join(f"{(n @ np.arange(256)) / n.sum():.4f},{np.count_nonzero(n)}" for n in counts)


def padded(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def to_media(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes of the text and `media`, its WebP file."""
    fields = [docs.schema[c] for c in keep if c not in ("n_bytes", "media")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                raw = [b or b"" for b in as_binary(batch.column("__text")).to_pylist()]
                made = [pa.array([len(b) for b in raw], pa.int64()), pa.array([store(padded(b)) for b in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], [*names, "n_bytes", "media"])

    return arrow_map(docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text")), run, schema)


READ = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def read_media(media: DataFrame, column: str = "media", keep: Sequence[str] = ("doc_id", "n_bytes"), pixels: bool = False) -> DataFrame:
    """`keep` columns and what the decoded pixel arrays show; with `pixels` also width, height and the RGB bytes (of frames, one below the other)."""
    extra = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgb", T.BinaryType())] if pixels else []
    made = [*READ.fields, *extra]
    fields = [media.schema[c] for c in keep if c not in {f.name for f in made}]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__media"):
                rows = []
                for b in as_binary(batch.column("__media")).to_pylist():
                    if b is None:
                        rows.append((None,) * len(made))
                        continue
                    payload, images = load(b)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(b), hashlib.sha256(b).hexdigest(), features(images))
                    rows.append(row + ((images[0].shape[1], sum(x.shape[0] for x in images), b"".join(x[:, :, :3].tobytes() for x in images)) if pixels else ()))
                types = {T.LongType: pa.int64(), T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}
                arrays = [pa.array([r[i] for r in rows], types[type(f.dataType)]) for i, f in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *arrays], [*names, *(f.name for f in made)])

    return arrow_map(media.select(*(media[c] for c in names), media[column].alias("__media")), run, T.StructType([*fields, *made]))
