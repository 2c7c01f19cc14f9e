"""Vertex ids made of a partition number and an offset, and small integer helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_BITS = 30


def compose(part: Column, offset: Column, offset_bits: int = OFFSET_BITS) -> Column:
    return F.shiftleft(part.cast("long"), offset_bits) + offset.cast("long")


def part_of(vid: Column, offset_bits: int = OFFSET_BITS) -> Column:
    return F.shiftright(vid.cast("long"), offset_bits)


def offset_of(vid: Column, offset_bits: int = OFFSET_BITS) -> Column:
    return vid.cast("long").bitwiseAND(F.lit((1 << offset_bits) - 1))


def whole(a: Column, n: int) -> Column:
    """a / n rounded towards zero, in integers: exact beyond 2**53 too."""
    return F.call_function("div", a.cast("long"), F.lit(n).cast("long"))


def remap_chunk_round_robin(vid: Column, parts: int, chunk: int, offset_bits: int = OFFSET_BITS) -> Column:
    """Chunks of `chunk` consecutive ids go to the partitions in turn."""
    v = vid.cast("long")
    turn = whole(v, chunk)
    return compose(turn % parts, whole(turn, parts) * chunk + v % chunk, offset_bits)


def remap_equal_vertex(vid: Column, parts: int, vertices: int, offset_bits: int = OFFSET_BITS) -> Column:
    """Equal runs of consecutive ids; the run length is rounded up, so that no id falls beyond the last partition."""
    v, chunk = vid.cast("long"), max(1, -(-vertices // parts))
    return compose(whole(v, chunk), v % chunk, offset_bits)


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def parse_bytes(text: str) -> int:
    """A size such as 64k, 8m or 2g, in bytes."""
    units = {"k": 10, "m": 20, "g": 30}
    s = text.strip().lower()
    return int(s[:-1]) << units[s[-1]] if s and s[-1] in units else int(s)
