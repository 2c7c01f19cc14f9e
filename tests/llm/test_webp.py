"""The decoder on streams with every feature of the format, written here by other means."""

import random

import numpy as np
import pytest

from tessera.llm import webp
from tessera.llm.webp import BitWriter


class Code:
    """A canonical code with uneven lengths over the symbols in use."""

    def __init__(self, symbols, size):
        self.size, symbols = size, sorted(set(symbols))
        self.symbols = symbols
        n = len(symbols)
        if n == 1:
            self.lengths = {symbols[0]: 1}
        elif n <= 12:
            self.lengths = {s: min(i + 1, n - 1) for i, s in enumerate(symbols)}
        else:
            k = (n - 1).bit_length()
            short = (1 << k) - n
            self.lengths = {s: k - (i < short) for i, s in enumerate(symbols)}
        order = sorted((length, s) for s, length in self.lengths.items())
        code, before, self.codes = 0, order[0][0], {}
        for length, s in order:
            code <<= length - before
            self.codes[s] = (code, length)
            code, before = code + 1, length

    def header(self, out):
        if len(self.symbols) == 1 and self.symbols[0] < 256:
            out.put(1 | 0 << 1 | 1 << 2, 3)
            out.put(self.symbols[0], 8)
            return
        out.put(0, 1)
        out.put(15, 4)  # all 19 code lengths, each of 4 or 5 bits: 13 of length 4, 6 of length 5
        inner = {s: 4 if s < 13 else 5 for s in range(19)}
        for s in webp.CODE_LENGTH_ORDER:
            out.put(inner[s], 3)
        codes, code, before = {}, 0, 4
        for length, s in sorted((v, k) for k, v in inner.items()):
            code <<= length - before
            codes[s] = (code, length)
            code, before = code + 1, length
        out.put(0, 1)
        at = 0
        while at < self.size:
            length = self.lengths.get(at, 0)
            run = 1
            while not length and at + run < self.size and run < 138 and at + run not in self.lengths:
                run += 1
            if run >= 11:
                self.emit(out, codes[18])
                out.put(run - 11, 7)
            elif run >= 3:
                self.emit(out, codes[17])
                out.put(run - 3, 3)
            else:
                run = 1
                self.emit(out, codes[length])
            at += run

    @staticmethod
    def emit(out, code):
        value, length = code
        for i in reversed(range(length)):
            out.put(value >> i & 1, 1)

    def put(self, out, symbol):
        if len(self.symbols) > 1 or self.symbols[0] >= 256:
            if len(self.symbols) > 1:
                self.emit(out, self.codes[symbol])


def prefix(value):
    """(code, extra bits, number of extra bits) of a length or distance."""
    for code in range(40):
        extra = 0 if code < 4 else (code - 2) >> 1
        low = code + 1 if code < 4 else ((2 + (code & 1)) << extra) + 1
        if low <= value < low + (1 << extra):
            return code, value - low, extra
    raise ValueError(value)


def put_image(out, pixels, width, main, cache_bits=0, references=True):
    """pixels: ARGB integers; greedy back-references, then the cache, then literals."""
    ops, at, cache = [], 0, {}
    while at < len(pixels):
        best = (0, 0)
        for far in (1, width, 7, 200):
            n = 0
            while references and far <= at and at + n < len(pixels) and n < 60 and pixels[at + n] == pixels[at + n - far]:
                n += 1
            best = max(best, (n, far))
        c = pixels[at]
        slot = (0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best[0] >= 3:
            ops.append(("copy", best[0], best[1] + 120))
            step = best[0]
        elif cache_bits and cache.get(slot) == c:
            ops.append(("cache", slot))
            step = 1
        else:
            ops.append(("pixel", c))
            step = 1
        if cache_bits:
            for p in pixels[at : at + step]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += step
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    green, red, blue, alpha, dist = [], [], [], [], []
    for op in ops:
        if op[0] == "pixel":
            for channel, s in ((alpha, 24), (red, 16), (green, 8), (blue, 0)):
                channel.append(op[1] >> s & 255)
        elif op[0] == "copy":
            green.append(256 + prefix(op[1])[0])
            dist.append(prefix(op[2])[0])
        else:
            green.append(280 + op[1])
    codes = [Code(s or [0], n) for s, n in ((green, 280 + (1 << cache_bits if cache_bits else 0)), (red, 256), (blue, 256), (alpha, 256), (dist, 40))]
    for c in codes:
        c.header(out)
    for op in ops:
        if op[0] == "pixel":
            for code, s in zip(codes, (8, 16, 0, 24), strict=False):
                code.put(out, op[1] >> s & 255)
        elif op[0] == "copy":
            for code, value in ((codes[0], op[1]), (codes[4], op[2])):
                c, extra, bits = prefix(value)
                code.put(out, c + (256 if code is codes[0] else 0))
                out.put(extra, bits)
        else:
            codes[0].put(out, 280 + op[1])


def header(width, height):
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1 | (height - 1) << 14, 28)
    out.put(1, 1)
    out.put(0, 3)
    return out


def finish(out):
    return out.value.to_bytes((out.size + 7) // 8 + 8, "little")


def image(rng, width, height, colours=None):
    if colours:
        return [rng.choice(colours) for _ in range(width * height)]
    base = [rng.randrange(1 << 32) for _ in range(9)]
    return [rng.choice(base) if rng.random() < 0.7 else rng.randrange(1 << 32) for _ in range(width * height)]


def argb(pixels):
    p = pixels.reshape(-1, 4).astype(np.uint32)
    return (p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]).tolist()


@pytest.mark.parametrize("cache_bits", [0, 3, 6])
def test_references_and_cache(cache_bits):
    rng = random.Random(cache_bits)
    for width, height in ((13, 9), (1, 30), (40, 20)):
        want = image(rng, width, height)
        out = header(width, height)
        out.put(0, 1)
        put_image(out, want, width, True, cache_bits)
        assert argb(webp.decode_vp8l(finish(out))) == want


def sub(a, b):
    return sum((((a >> s & 255) - (b >> s & 255)) & 255) << s for s in (0, 8, 16, 24))


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng = random.Random(mode)
    width, height, bits = 11, 10, 2
    want = image(rng, width, height)
    left_over = []
    for i, p in enumerate(want):
        y, x = divmod(i, width)
        if not i:
            guess = 0xFF000000
        elif not y:
            guess = want[i - 1]
        elif not x:
            guess = want[i - width]
        else:
            guess = webp.predict(mode, want[i - 1], want[i - width], want[i - width + 1], want[i - width - 1])
        left_over.append(sub(p, guess))
    out = header(width, height)
    out.put(1 | 0 << 1 | (bits - 2) << 3, 6)
    put_image(out, [mode << 8] * 9, 3, False)
    out.put(0, 1)
    put_image(out, left_over, width, True)
    assert argb(webp.decode_vp8l(finish(out))) == want


def test_cross_colour_and_subtract_green():
    rng = random.Random(3)
    width, height, bits = 9, 7, 2
    want = image(rng, width, height)
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: signed(t) * signed(c) >> 5
    factors = [rng.randrange(1 << 24) for _ in range(6)]
    stored = []
    for i, p in enumerate(want):
        y, x = divmod(i, width)
        a, r, g, b = (p >> s & 255 for s in (24, 16, 8, 0))
        # undone last, so done first: subtract green
        r, b = (r - g) & 255, (b - g) & 255
        f = factors[(y >> bits) * 3 + (x >> bits)]
        b = (b - delta(f >> 8 & 255, g) - delta(f >> 16 & 255, r)) & 255
        r = (r - delta(f & 255, g)) & 255
        stored.append(a << 24 | r << 16 | g << 8 | b)
    out = header(width, height)
    out.put(1 | 2 << 1, 3)
    out.put(1 | 1 << 1 | (bits - 2) << 3, 6)
    put_image(out, factors, 3, False, references=False)
    out.put(0, 1)
    put_image(out, stored, width, True)
    assert argb(webp.decode_vp8l(finish(out))) == want


@pytest.mark.parametrize("n", [2, 4, 16, 100])
def test_palette(n):
    rng = random.Random(n)
    width, height = 13, 6
    table = [rng.randrange(1 << 32) for _ in range(n)]
    index = [rng.randrange(n) for _ in range(width * height)]
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per, packed = 8 >> bits, -(-width // (1 << bits))
    stored = []
    for y in range(height):
        for x in range(packed):
            green = sum(index[y * width + x * (1 << bits) + k] << (k * per) for k in range(1 << bits) if x * (1 << bits) + k < width)
            stored.append(255 << 24 | green << 8)
    out = header(width, height)
    out.put(1 | 3 << 1 | (n - 1) << 3, 11)
    put_image(out, [sub(c, table[i - 1] if i else 0) for i, c in enumerate(table)], n, False)
    out.put(0, 1)
    put_image(out, stored, packed, True)
    assert argb(webp.decode_vp8l(finish(out))) == [table[i] for i in index]


def test_store_and_load():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000, 3_200_000):
        for t in (bytes(rng.randrange(256) for _ in range(min(n, 4000))) * max(1, n // 4000), b"a" * n, b"ab" * (n // 2), bytes(range(17)) * (n // 17)):
            payload = webp.padded(t)
            assert len(payload) % 192 == 0 and payload and payload.startswith(t)
            media = webp.store(payload)
            assert webp.load(media)[0] == payload and media == webp.store(payload)
    with pytest.raises(ValueError):
        webp.store(b"x")
    with pytest.raises(ValueError):
        webp.decode_file(b"nothing of the kind")


def test_few_codes_and_a_stream_with_bytes_behind_it(monkeypatch):
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(400)]
    payload = webp.padded(b" ".join(words[int(n)] for n in rng.integers(0, 400, 40_000)) + b"\xff" * 999)
    seen, read = [], webp.read_prefix
    monkeypatch.setattr(webp, "read_prefix", lambda *a: (seen.append(read(*a)), seen[-1])[1])
    for raw in (payload, payload[:1920], payload[:384] + payload[:384], b" " * 192, bytes(range(192)) * 2):
        media = webp.store(raw)
        seen.clear()
        assert webp.load(media)[0] == raw
        # the palette's green and alpha, the pixels' green and distances
        assert sum(c.width > 0 for c in seen) <= 4
        grey = webp.decode_file(media)
        assert (grey[:, :, 0] == grey[:, :, 1]).all() and (grey[:, :, 2] == grey[:, :, 1]).all() and (grey[:, :, 3] == 255).all()
        body = next(b for k, b in webp.chunks(media) if k == b"VP8L")
        for behind in (bytes(5000), bytes(rng.integers(0, 256, 5000).tolist()), b"\xff" * 5000):
            assert (webp.decode_vp8l(body + behind) == grey).all()
        with pytest.raises(ValueError):
            webp.decode_vp8l(body[: len(body) // 2])


def test_codes_are_not_copied_to_be_read():
    """Most codes serve few pixels: a list of all their table's entries costs more than those pixels."""
    code = webp.prefix(bytes([2, 2, 2, 3, 3]))
    assert np.shares_memory(np.asarray(code.listed()), code.table) and [*code.listed()] == code.table.tolist()


def test_lengths_and_distances_beyond_their_tables():
    values = np.array([1, 4, 5, 120, 4096, 65534, 65535, 65536, 65537, 1 << 20])
    symbol, extra, bits = webp._prefixed(values)
    for v, s, e, n in zip(values.tolist(), symbol.tolist(), extra.tolist(), bits.tolist(), strict=True):
        assert webp._spelt(s, e) == (v, n)
        assert [int(x[0]) for x in webp._prefixed(np.array([v]))] == [s, e, n]
