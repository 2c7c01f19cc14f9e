"""Exact n-gram Jaccard self-join by PartEnum signatures, and its connected components.

A text's set holds the hashes of its distinct n-word shingles.  Sets are put in
bands of nearly equal sizes; within a band, and between neighbouring bands, two
similar enough sets differ in at most k elements.  The feature domain is cut into
n1 parts of 3 sub-parts each, with n1 * 2 > k: some part then holds at most one
difference, and leaving out one of its sub-parts leaves equal projections.  So
every (part, sub-part left out) gives a signature, and similar sets share one.

Equal sets are one node.  A signature's rows are sorted and read as a stream: all
but the first node name that one as their leader.  Signatures of very many nodes
(found by a sample of the nodes, which decides nothing but where rows go) are
dealt out by node as well, and the leaders of their parts are linked to the least.
Within the nodes that share a signature no list of all pairs is made: each node is
checked against its nearest leader, then components are compared through parity
sketches, whose Hamming distance never exceeds the sets' difference, so a pair
that the sketches rule out cannot link.  Only signatures that still hold several
components are looked at, those with the same nodes once; where sketches folded to
a quarter rule out all their pairs, that settles them.  What the sketches leave
between different components is verified on the sets themselves until no such pair
is untested.  No link between components is lost; links inside a component are not
listed.

A set's name has 64 bits.  Names that two sets share are found by a second hash of
64 bits and given anew, so sets are told apart by 128 bits; that two different
shingles of one pair of sets agree has a chance of about 1e-13.

Defined results: a null text, or one without words, has an empty set, linked with
nothing; fewer words than a shingle make one shingle; repeated rows are equal
sets; the component id is the smallest document id, null ids last, so equal ids
tie without harm; an empty table gives an empty result; texts of any length are
taken whole; only the key and the text are read, so other columns may have any
names, and the result has its own three.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import arrow_map, packed_checkpoint, release, small
from tessera.llm.textops import U64, Words, buffers, mix64, slices, whole_hash
from tessera.session import ensure_checkpoint_dir

SUBPARTS = 3
#: Below this threshold a projection holds few elements: bands are then wider (fewer groups), parts are
#: a few more than needed, and empty projections can be left out.
SELECTIVE = 0.85
#: Bits of a signature, which are most of what is shuffled.  Signatures that agree by chance only bring
#: together sets that sketches then rule out; no link is lost.
SIGNATURE_BITS = 48
#: Least cells of a sketch.
SKETCH_BITS = 1024
#: Nodes of one signature that a task compares at once; more are compared block against block.
BLOCK = 4096
#: One node in PROBE is a probe; a signature of PROBES of them or more is dealt out in SALTS parts.  The
#: list of such signatures is cut to the HEAVY largest, which bounds it; the rest stay whole.
PROBE, PROBES, SALTS, HEAVY = 64, 32, 64, 100_000
#: Seed of the hash by which equal names of different sets are found.
CHECK = 65535


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of the column __text."""
    raw, offsets = buffers(batch.column("__text"))
    words = Words(raw, offsets)
    h, at = words.shingles(n)
    first = np.searchsorted(words.row[at], np.arange(batch.num_rows + 1))
    out = []
    for i in range(batch.num_rows):
        if 0 < words.count[i] < n:
            out.append(np.array([whole_hash(words, i)], dtype=U64))
        else:
            out.append(np.unique(h[first[i] : first[i + 1]]))
    return out


def node_of(s: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        y = mix64(s + U64(seed) * U64(0x9E3779B97F4A7C15))
        x = np.array([mix64(y).sum(dtype=U64) ^ mix64(np.bitwise_xor.reduce(y) + U64(len(s)))], dtype=U64)
    return int(mix64(x).view(np.int64)[0])


class Names:
    """Names of sets: the first hash that is no name of two sets.  Fewer first bits serve to test this."""

    def __init__(self, shared: frozenset[int] = frozenset(), bits: int = 64):
        self.shared, self.low = shared, 64 - bits

    def __call__(self, s: np.ndarray) -> int:
        name, seed = node_of(s) >> self.low, 0
        while name in self.shared:
            seed += 1
            name = node_of(s, seed)
        return name


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of its cells: a power of two, at least SKETCH_BITS and 4 an element."""
    bits = max(SKETCH_BITS, 1 << (4 * len(s) - 1).bit_length())
    cells = (mix64(s) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def coarse(full: bytes) -> bytes:
    """A sketch folded to a quarter: distances only become less."""
    return np.bitwise_xor.reduce(np.frombuffer(full, dtype=U64).reshape(4, -1), axis=0).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, the longer ones folded (halves xor-ed) to the shortest one's length."""
    low = min(map(len, sketches))
    out = np.empty((len(sketches), low // 8), dtype=U64)
    for size in {len(x) for x in sketches}:
        at = [i for i, x in enumerate(sketches) if len(x) == size]
        rows = np.frombuffer(b"".join(sketches[i] for i in at), dtype=U64).reshape(len(at), size // low, low // 8)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


class Bands:
    """Size bands for a threshold of p / q, and the most differences of a band and of a pair of neighbours.

    A band spans `width` times the ratio that two similar sets' sizes can have, so
    a set has partners in its own and the neighbouring bands at most, and in a
    neighbour only if its size lies within that ratio of it.
    """

    def __init__(self, p: int, q: int):
        self.p, self.q, self.low, self.high = p, q, [1], []
        self.loose = p < SELECTIVE * q
        self.width = 2 if self.loose else 1

    def of(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            top = self.low[-1]
            for _ in range(self.width):
                top = top * self.q // self.p
            self.high.append(top)
            self.low.append(top + 1)
        return int(np.searchsorted(self.high, size))

    def differences(self, band: int, upper: int) -> int:
        """Of two sets, one of `band` and one of `upper` (the same or the next)."""
        self.of(self.low[upper])
        small = self.high[band]
        large = min(self.high[upper], small * self.q // self.p)
        return (small + large) * (self.q - self.p) // (self.q + self.p)

    def groups(self, size: int) -> list[tuple[int, int]]:
        """(group, k) that a set of this size takes part in: its band's, and those with both neighbours."""
        b = self.of(size)
        pairs = [(b, b)]
        if size * self.q // self.p > self.high[b]:
            pairs.append((b, b + 1))
        if b and self.high[b - 1] * self.q >= self.p * size:
            pairs.append((b - 1, b))
        return [(lo * 2 + (hi > lo), k) for lo, hi in pairs if (k := self.differences(lo, hi)) > 0]


@lru_cache(maxsize=4)
def bands(p: int, q: int) -> Bands:
    return Bands(p, q)


def signatures(sets: list[np.ndarray], p: int, q: int) -> list[np.ndarray]:
    """Each set's signatures, as numbers of SIGNATURE_BITS bits; none for an empty set."""
    layout = bands(p, q)
    owner, group, parts, need, copies = [], [], [], [], []
    for i, s in enumerate(sets):
        for g, k in layout.groups(len(s)) if len(s) else ():
            owner.append(i)
            group.append(g)
            least = k // 2 + 1  # parts, for one of them to hold at most one difference
            parts.append(least + (1 + least // 16 if layout.loose else 0))
            need.append(least)
            copies.append(s)
    if not owner:
        return [np.zeros(0, np.int64) for _ in sets]
    size = np.array([len(s) for s in copies])
    element = np.concatenate(copies)
    n1, g = np.array(parts), np.array(group, dtype=U64)
    base = np.concatenate(([0], np.cumsum(n1 * SUBPARTS)))
    dealt = mix64(element ^ np.repeat(mix64(g + U64(1)), size))
    cell = (dealt >> U64(11)).astype(np.int64) % np.repeat(n1 * SUBPARTS, size) + np.repeat(base[:-1], size)
    value = mix64(element + U64(77))
    # exact sums of 32-bit halves, then of whole words modulo 2**64
    low = np.bincount(cell, weights=(value & U64(0xFFFFFFFF)).astype(np.float64), minlength=base[-1]).astype(U64)
    high = np.bincount(cell, weights=(value >> U64(32)).astype(np.float64), minlength=base[-1]).astype(U64)
    sums = (low + (high << U64(32))).reshape(-1, SUBPARTS)
    whole = sums.sum(axis=1, dtype=U64)
    part = (np.arange(base[-1] // SUBPARTS) - np.repeat(base[:-1] // SUBPARTS, n1)).astype(U64)
    salt = mix64(np.repeat(mix64(g + U64(9)), n1) + part)
    left_out = whole[:, None] - sums  # the projection without one sub-part
    out = mix64(mix64(left_out + U64(3)) ^ (salt[:, None] + np.arange(SUBPARTS, dtype=U64) * U64(0x9E3779B97F4A7C15)))
    out = (out >> U64(64 - SIGNATURE_BITS)).view(np.int64)
    # A part is thin if one sub-part holds all its elements.  A good part that is not thin gives an equal
    # projection that is not empty; with more such parts than half of k, empty projections are not needed.
    filled = np.bincount(cell, minlength=base[-1]).reshape(-1, SUBPARTS)
    rest = filled.sum(axis=1)[:, None] - filled
    thick = np.add.reduceat((rest.min(axis=1) > 0).astype(np.int64), base[:-1] // SUBPARTS)
    keep = (rest > 0) | np.repeat(thick < np.array(need), n1)[:, None]
    first = np.concatenate(([0], np.cumsum(np.bincount(np.array(owner), weights=n1, minlength=len(sets)).astype(np.int64))))
    return [out[first[i] : first[i + 1]][keep[first[i] : first[i + 1]]] for i in range(len(sets))]


def _named(source: DataFrame, n: int, p: int, q: int, names: Names) -> DataFrame:
    """__key, node, check (a second hash of the set), n_shingles and a probe's signatures; node is null for an empty set."""
    columns = ["__key", "node", "check", "n_shingles", "probe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                sets = shingle_sets(batch, n)
                node = [names(s) if len(s) else None for s in sets]
                check = [node_of(s, CHECK) if len(s) else None for s in sets]
                probes = [i for i, x in enumerate(check) if x is not None and x % PROBE == 0]
                probe: list[np.ndarray | None] = [None] * len(sets)
                for i, found in zip(probes, signatures([sets[i] for i in probes], p, q), strict=True):
                    probe[i] = found
                made = [pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(probe, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("__key"), *made], columns)

    return arrow_map(source, run, f"__key {source.schema['__key'].dataType.simpleString()}, node long, check long, n_shingles long, probe array<long>")


def _signed(source: DataFrame, n: int, p: int, q: int, names: Names, heavy: np.ndarray) -> DataFrame:
    """Signatures (sig), a part and node; part is -1 but for the sorted `heavy` signatures.  A task skips sets that it has just seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "__text"):
                fresh: dict[int, np.ndarray] = {}
                for s in shingle_sets(batch, n):
                    if len(s) and (node := names(s)) not in seen:
                        fresh[node] = s
                        seen.add(node)
                if len(seen) > 200_000:
                    seen.clear()
                found = signatures(list(fresh.values()), p, q)
                count = [len(x) for x in found]
                if sum(count):
                    sig, node = np.concatenate(found), np.repeat(np.array(list(fresh), dtype=np.int64), count)
                    part = np.full(len(sig), -1, dtype=np.int8)
                    if len(heavy):
                        at = heavy[np.minimum(np.searchsorted(heavy, sig), len(heavy) - 1)] == sig
                        part[at] = mix64(node[at].view(U64)) % U64(SALTS)
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(part), pa.array(node)], ["sig", "part", "node"])

    return arrow_map(source, run, "sig long, part byte, node long")


def _first_of_like(new: np.ndarray, part: np.ndarray, node: np.ndarray, seen: set[tuple[int, int, int]]) -> np.ndarray:
    """Whether to keep each row: signatures with the nodes of one seen before, by their number and 128 bits, are left out.

    new: where a group of one signature and part begins.  The first and the last group may go on in other batches, and a
    heavy signature's parts hold only some of its nodes: those stay.
    """
    first = np.flatnonzero(new)
    keep = np.ones(len(node), dtype=bool)
    many = np.diff(first)
    some = np.flatnonzero((many > 1) & (part[first[:-1]] < 0))
    some = some[some > 0]
    if not len(some):
        return keep
    hashes = [np.add.reduceat(mix64(node.view(U64) ^ mix64(np.array([seed], dtype=U64))), first)[some].tolist() for seed in (1, 2)]
    if len(seen) > 200_000:
        seen.clear()
    for group, key in zip(some.tolist(), zip(many[some].tolist(), *hashes, strict=True), strict=True):
        if key in seen:
            keep[first[group] : first[group + 1]] = False
        seen.add(key)
    return keep


def _shared(signed: DataFrame) -> DataFrame:
    """sig, node and low, the least node of the signature's part, of each node that shares a signature.

    Of signatures that a task finds with the same nodes, the first alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: signature, part, node, its group's least node, whether it is given out
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            sig, part, node = (batch.column(c).to_numpy() for c in ("sig", "part", "node"))
            if held is not None:
                sig, part, node = (np.concatenate(([h], x)).astype(x.dtype) for h, x in zip(held, (sig, part, node), strict=False))
            if not len(sig):
                continue
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
            fresh = new.copy()
            fresh[1:] |= node[1:] != node[:-1]
            sig, part, node, new = sig[fresh], part[fresh], node[fresh], new[fresh]
            low = node[np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))]
            if held is not None:
                first = int(np.argmax(np.append(new[1:], True))) + 1  # rows of the group that goes on
                low[:first] = held[3]
            good = ~new | (part >= 0)
            good[:-1] |= ~new[1:]
            if held is not None:
                good[0] = (good[0] or held[3] != held[2]) and not held[4]
            out = np.flatnonzero(good & _first_of_like(new, part, node, seen))
            held = (sig[-1], part[-1], node[-1], low[-1], bool(good[-1]) or (len(sig) == 1 and held is not None and held[4]))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, node, low)], ["sig", "node", "low"])

    return arrow_map(signed.repartition("sig", "part").sortWithinPartitions("sig", "part", "node"), run, "sig long, node long, low long")


def _held(source: DataFrame, n: int, names: Names) -> DataFrame:
    """node, size, its set, sketch and the sketch folded to a quarter (coarse)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                sets = [s for s in shingle_sets(batch, n) if len(s)]
                arrays = [pa.array([names(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(full := [sketch(s) for s in sets], pa.binary()), pa.array([coarse(x) for x in full], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "size", "elements", "sketch", "coarse"])

    return arrow_map(source, run, "node long, size long, elements binary, sketch binary, coarse binary")


def _distance(pairs: DataFrame) -> DataFrame:
    """Adds the sketches' Hamming distance of columns sketch_a, sketch_b as `apart`, in place of them."""
    names = [c for c in pairs.columns if not c.startswith("sketch_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            apart = np.zeros(batch.num_rows, dtype=np.int64)
            low = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], dtype=np.int64)
            for size in np.unique(low):  # of one length at a time
                at = np.flatnonzero(low == size).tolist()
                both = folded([*(left[i] for i in at), *(right[i] for i in at)])
                apart[at] = np.bitwise_count(both[: len(at)] ^ both[len(at) :]).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(apart)], [*names, "apart"])

    return arrow_map(pairs, run, ", ".join(f"{c} long" for c in [*names, "apart"]))


def _verified(pairs: DataFrame, held: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) with q * intersection >= p * union."""
    ends = small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 16)
    few = held.join(ends, "node", "left_semi")  # sets of pairs alone are shuffled
    x = pairs.select("a", "b").join(few.select(F.col("node").alias("a"), F.col("elements").alias("sa")), "a")
    x = x.join(few.select(F.col("node").alias("b"), F.col("elements").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (sa, sb) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                sa, sb = np.frombuffer(sa.as_buffer(), dtype=U64), np.frombuffer(sb.as_buffer(), dtype=U64)
                if len(sa) > len(sb):
                    sa, sb = sb, sa
                at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
                both = int((sb[at] == sa).sum())
                if q * both >= p * (len(sa) + len(sb) - both):
                    good.append(i)
            taken = batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
            if taken.num_rows:
                yield taken

    return arrow_map(x.select("a", "b", "sa", "sb"), run, "a long, b long")


def connect(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, comp) after joining by links (a, b): each component takes its smallest label.

    Smallest-neighbour steps with pointer jumping over the labels; every step is
    checkpointed, and only counts come to the driver.
    """
    names = labels.select(F.col("node"), F.col("comp"))
    edges = (
        links.join(names.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a")
        .join(names.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        .where("x <> y")
        .select("x", "y")
    )
    edges = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    root = edges.select(F.col("x").alias("v")).distinct().withColumn("c", F.col("v")).checkpoint()
    while True:
        near = edges.join(root.select(F.col("v").alias("y"), "c"), "y").groupBy(F.col("x").alias("v")).agg(F.min("c").alias("m"))
        low = root.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = low.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        after = low.join(jump, "c").select("v", "was", F.col("cc").alias("c")).checkpoint()
        if after.where("c <> was").isEmpty():
            break
        root = after.select("v", "c")
        del near, low, jump, after
        release(labels.sparkSession)
    moved = root.select(F.col("v").alias("comp"), "c")
    return labels.join(moved, "comp", "left").select("node", F.coalesce("c", "comp").alias("comp")).checkpoint()


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, node, comp and m, the number of nodes, of signatures with several components; of those with the same nodes one."""
    rows = shared.select("sig", "node").join(labels, "node")
    digest = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)]
    mixed = rows.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), *digest).where("c0 <> c1")
    return rows.join(mixed.groupBy("m", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "m"), "sig").checkpoint()


def _across(members: DataFrame, p: int, q: int, best: bool | None) -> DataFrame:
    """Pairs of different components under one signature that the sketches do not rule out.

    members: sig, node, comp, m, size, sketch.  With `best`, a task gives the nearest
    pair of each two components only; if that is None, the signatures (sig) with such pairs.
    """
    blocks = F.ceil(F.col("m") / BLOCK)
    dealt = members.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "size", "sketch")
    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        node, comp, size, own = (t.column(c).to_numpy() for c in ("node", "comp", "size", "own"))
        bits = folded(t.column("sketch").to_pylist())
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        step = max(1, (1 << 21) // max(1, len(right) * bits.shape[1]))
        for at in range(0, len(left), step):
            a = left[at : at + step]
            apart = np.bitwise_count(bits[a][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64)
            # a link needs (q + p) * differences <= (q - p) * (both sizes)
            good = ((q + p) * apart <= (q - p) * (size[a][:, None] + size[right][None, :])) & (comp[a][:, None] != comp[right][None, :])
            if i == j:
                good &= node[a][:, None] < node[right][None, :]
            x, y = np.nonzero(good)
            if len(x) and best is None:
                return pa.RecordBatch.from_arrays([t.column("sig").combine_chunks()[:1]], ["sig"])
            if len(x):
                found.append((a[x], right[y], apart[x, y]))
        if not found:
            return None
        a, b, apart = (np.concatenate([f[k] for f in found]) for k in range(3))
        a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
        ca, cb = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
        if best:
            order = np.lexsort((node[b], node[a], apart, cb, ca))
            a, b, ca, cb, apart = (x[order] for x in (a, b, ca, cb, apart))
            new = np.ones(len(a), dtype=bool)
            new[1:] = (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])
            a, b, ca, cb, apart = (x[new] for x in (a, b, ca, cb, apart))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], ca, cb, apart)], ["a", "b", "ca", "cb", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sig", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, s].tolist())
                if key != now and kept:
                    out = compare(kept)
                    kept = []
                    if out is not None:
                        yield out
                now = key
                kept.append(batch.slice(s, e - s))
        if kept and (out := compare(kept)) is not None:
            yield out

    if best is None:
        return arrow_map(dealt, run, "sig long").distinct()
    pairs = arrow_map(dealt, run, "a long, b long, ca long, cb long, apart long")
    if best:
        return pairs.groupBy("ca", "cb").agg(F.min(F.struct("apart", "a", "b")).alias("s")).select("s.a", "s.b")
    return pairs.select("a", "b").distinct()


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, p: int = 80, q: int = 100, name_bits: int = 64) -> DataFrame:
    """key, n_shingles and component_id of each document, at Jaccard similarity of p / q or more."""
    ensure_checkpoint_dir(docs.sparkSession)
    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    names = Names(bits=name_bits)
    while True:
        named = _named(source, n, p, q, names).checkpoint()
        twice = named.where("node is not null").groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 <> c1")
        twice = frozenset(r["node"] for r in twice.select("node").collect())  # of N sets about N * N / 2**65
        if not twice:
            break
        names = Names(names.shared | twice, name_bits)
    probes = named.where("probe is not null").select("node", "probe").dropDuplicates(["node"]).select(F.explode("probe").alias("sig")).groupBy("sig").agg(F.count("*").alias("c"))
    heavy = probes.where(F.col("c") >= PROBES).orderBy(F.desc("c"), "sig").limit(HEAVY).select("sig").collect()
    heavy = np.sort(np.array([r["sig"] for r in heavy], dtype=np.int64))
    shared = packed_checkpoint(_shared(_signed(source.select("__text"), n, p, q, names, heavy)))
    release(docs.sparkSession)
    # one document of each node that shares a signature, its text read again
    wanted = shared.select("node").distinct().checkpoint()
    chosen = named.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64("__key")).alias("__pick"))
    chosen = small(chosen.select("__pick").distinct(), 16)
    texts = source.withColumn("__pick", F.xxhash64("__key")).join(chosen, "__pick", "left_semi").select("__text")
    held = _held(texts, n, names).join(wanted, "node", "left_semi").dropDuplicates(["node"]).checkpoint()
    release(docs.sparkSession)
    light = held.select("node", "size", "sketch")
    rough = held.select("node", "size", F.col("coarse").alias("sketch"))

    # first links: each node with the nearest of its leaders, as coarse sketches show it; what they miss is found below
    leaders = shared.where("node <> low").select("node", F.col("low").alias("leader")).distinct()
    if len(heavy):  # parts of one signature: their leaders with the least of them
        parts = shared.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in heavy], "sig long")), "sig").select("sig", "low").distinct()
        least = parts.groupBy("sig").agg(F.min("low").alias("leader"))
        leaders = leaders.unionAll(parts.join(least, "sig").where("low <> leader").select(F.col("low").alias("node"), "leader")).distinct()
    near = leaders.join(rough.select("node", F.col("size").alias("na"), F.col("sketch").alias("sketch_a")), "node")
    near = _distance(near.join(rough.select(F.col("node").alias("leader"), F.col("size").alias("nb"), F.col("sketch").alias("sketch_b")), "leader"))
    near = near.where((q + p) * F.col("apart") <= (q - p) * (F.col("na") + F.col("nb")))
    near = near.groupBy("node").agg(F.min(F.struct("apart", "leader")).alias("s")).select(F.least("node", "s.leader").alias("a"), F.greatest("node", "s.leader").alias("b")).distinct()
    tested = near.checkpoint()
    release(docs.sparkSession)
    labels = connect(_verified(tested, held, p, q), wanted.withColumn("comp", F.col("node")))

    # then between components: components only grow, so a signature without a possible pair now has none later
    mixed = _unsettled(shared, labels)
    possible = small(_across(mixed.join(rough, "node"), p, q, None), 8)
    shared = mixed.join(possible, "sig", "left_semi").select("sig", "node").checkpoint()
    del mixed, possible
    release(docs.sparkSession)
    # the nearest pairs first, until none is untested
    for best in (True, False):
        members = _unsettled(shared, labels).join(light, "node")
        pairs = _across(members, p, q, best).join(tested, ["a", "b"], "left_anti").checkpoint()
        del members
        release(docs.sparkSession)
        labels = connect(_verified(pairs, held, p, q), labels)
        tested = tested.unionAll(pairs)
        release(docs.sparkSession)

    full = named.select("__key", "node", "n_shingles").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = full.where("comp is not null").groupBy("comp").agg(F.min("__key").alias("low"))
    return full.join(least, "comp", "left").select(F.col("__key").alias(key), "n_shingles", F.when(F.col("comp").isNull(), F.col("__key")).otherwise(F.col("low")).alias("component_id"))
