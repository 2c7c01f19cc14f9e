"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words of a run of rows are laid out as a trie in depth-first order
(sorted words: a word's states up to its common prefix with the word before
are the trie path already walked).  A node's state is the last token of the
encoding of its prefix.  The last token is the one suffix token whose pairing
with the last token before it could not have merged otherwise, so every shared
prefix is encoded once.

Defined results: null text is the empty text (no ids); texts of any length are
encoded whole; repeated rows give repeated results; ties cannot occur, merges
have one order; an empty table gives an empty result.  Only `keep` columns are carried, and an output column wins
over a kept one of the same name.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.frames import arrow_map
from tessera.llm.textops import as_binary, slices

#: White space as the split pattern has it, spelt out because libraries differ on the separators 1C to 1F.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf" ?\p{{L}}+| ?\p{{N}}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: White space, in the widest sense, and a space after it.
AFTER_WHITE = re.compile(r"\s ")
#: Encoded words that a task keeps between rows; when full, those that several runs of rows held stay.
CACHE_WORDS = 150_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 19
#: Remembered seams of a task and matcher steps of a Python worker.
CACHE_SEAMS, CACHE_STEPS = 250_000, 450_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which vocabulary files spell bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str, encoder: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max(*ids.values(), *self.special.values()) + 1
        self.bytes = [b""] * size
        for b, i in ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        if not encoder:
            return
        self.ids = ids
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order = [0] * size  # when a token appears: 0 for bytes, then by merge
        for r, m in enumerate(spec["model"]["merges"], 1):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = raw(a), raw(b)
            out = self.ids[left + right]
            pair = (self.ids[left], self.ids[right])
            self.rank.setdefault(pair, r)
            if out not in self.parts:
                self.parts[out], self.order[out] = pair, r
        self.longest = max(map(len, self.ids))
        self.splitter = regex.compile(SPLIT)
        self.cutter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.paired: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.common: set[str] = set()  # cached words met again in a later run of rows

    def joins(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are under the merge order.

        Both sides are unmerged from the latest step back; at each step the pair
        that then met at the seam must not have merged before that step.
        """
        key = a << 20 | b
        known = self.paired.get(key)
        if known is None:
            rank, order, parts = self.rank, self.order, self.parts
            before = 1 << 60
            while True:
                merged = rank.get((a, b))
                if merged is not None and merged < before:
                    known = False
                    break
                x, y = order[a], order[b]
                if not x and not y:
                    known = True
                    break
                if x > y:  # the left side was made later: its right part met b before
                    before, a = x, parts[a][1]
                else:  # at an equal step the seam, further left, would have merged first
                    before, b = y + 1, parts[b][0]
            if len(self.paired) >= CACHE_SEAMS:
                self.paired.clear()
            self.paired[key] = known
        return known

    def automaton(self) -> None:
        """Suffix matcher over the vocabulary: `step` by (state, byte), `ends` the tokens that end in a state, longest first."""
        step: dict[int, int] = {}
        depth_first: list[list[int]] = [[]]  # states by depth
        own, size = [-1], [0]
        for token, i in self.ids.items():
            state = 0
            for b in token:
                key = state << 8 | b
                state = step.get(key, 0)
                if not state:
                    state = step[key] = len(own)
                    own.append(-1)
                    size.append(size[key >> 8] + 1)
                    while len(depth_first) <= size[state]:
                        depth_first.append([])
                    depth_first[size[state]].append(key)
            own[state] = i
        self.step, self.ends, fail = step, [()] * len(own), [0] * len(own)
        for level in depth_first:
            for key in level:
                state, parent, b = step[key], key >> 8, key & 255
                at = fail[parent]
                while parent and at and (at << 8 | b) not in step:
                    at = fail[at]
                fail[state] = step.get(at << 8 | b, 0) if parent else 0
                self.ends[state] = (((own[state], size[state]),) if own[state] >= 0 else ()) + self.ends[fail[state]]
        self.fail = fail

    def walk(self, words: Sequence[bytes]) -> Iterator[list[int]]:
        """Encodings of sorted distinct words, depth-first over their trie."""
        if not hasattr(self, "step"):
            self.automaton()
        step, ends, fail, joins, paired = self.step, self.ends, self.fail, self.joins, self.paired
        last, back, states = [-1], [0], [0]  # by depth on the present path: last token, its start, matcher state
        before = b""
        for word in words:
            keep, top = 0, min(len(word), len(before))
            while keep < top and word[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], back[keep + 1 :], states[keep + 1 :]
            state, end = states[keep], keep
            for b in word[keep:]:
                end += 1
                key = state << 8 | b
                after = step.get(key)
                while after is None:
                    state = fail[state]
                    after = step.get(state << 8 | b)
                    if after is None and not state:
                        raise ValueError("the vocabulary does not cover all bytes")
                if len(step) < CACHE_STEPS:
                    step[key] = after
                state = after
                for token, length in ends[state]:
                    start = end - length
                    if start:
                        left = last[start]
                        fits = paired.get(left << 20 | token)
                        if not (joins(left, token) if fits is None else fits):
                            continue
                    last.append(token)
                    back.append(start)
                    states.append(state)
                    break
                else:
                    raise ValueError("merges and vocabulary do not agree")
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at = back[at]
            out.reverse()
            yield out
            before = word

    def chunks(self, text: str) -> list[str]:
        """Cuts that no split crosses: before a space, unless white space stands before it."""
        if AFTER_WHITE.search(text):
            return self.splitter.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [*map(" ".__add__, rest)]

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        gc.disable()  # millions of small lists and no cycles: collections would take a third of the time
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        find, known = self.splitter.findall, self.words
        cut: list[list[tuple[list[str], bytes]]] = []
        fresh: set[str] = set()
        for text in texts:
            pieces, at = [], 0
            for m in self.cutter.finditer(text) if self.cutter else ():
                pieces.append((self.chunks(text[at : m.start()]), self.special[m.group()].to_bytes(4, "little")))
                at = m.end()
            pieces.append((self.chunks(text[at:] if at else text), b""))
            cut.append(pieces)
            for chunks, _ in pieces:
                fresh.update(chunks)
        self.common |= fresh & known.keys()
        if len(known) + len(fresh) > CACHE_WORDS:
            self.words = known = {w: known[w] for w in self.common}
            if len(known) > CACHE_WORDS // 2:  # learn anew which words are common
                self.common = fresh & known.keys()
        fresh.difference_update(known)
        words = {c: find(c) for c in fresh}
        plain = {w for ws in words.values() for w in ws}
        self.common |= plain & known.keys()
        plain.difference_update(known)
        spelt = sorted(plain)  # code points order as their UTF-8 bytes do
        for w, got in zip(spelt, self.walk([w.encode() for w in spelt]), strict=True):
            known[w] = array("I", got).tobytes()
        chunk = {c: b"".join(map(known.__getitem__, ws)) for c, ws in words.items() if len(ws) != 1}
        known.update(chunk)  # several words without a space between them: seldom met again, so not kept
        out = [b"".join([b"".join(map(known.__getitem__, chunks)) + special for chunks, special in pieces]) for pieces in cut]
        for c in chunk:
            del known[c]
        return out

    def rest(self) -> None:
        """Drops what was kept between runs of rows."""
        self.words, self.common = {}, set()
        self.paired.clear()

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; bytes that are no UTF-8 become U+FFFD, an unknown id nothing."""
        size, table = len(self.bytes), self.bytes
        got = np.frombuffer(ids, dtype="<u4")
        if len(got) and int(got.max()) >= size:
            got = got[got < size]
        return b"".join(map(table.__getitem__, got.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str, encoder: bool = True) -> Vocabulary:
    """One vocabulary a Python worker and path; without `encoder` only what decoding needs."""
    return Vocabulary(path, encoder)


def _kept(df: DataFrame, keep: Sequence[str], made: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in keep if c not in made]


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns, ids (binary, little-endian unsigned 32-bit) and n_tokens of each row's whole text."""
    fields = _kept(docs, keep, ("ids", "n_tokens"))
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    source = docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, "__text", SLICE):
                texts = [(b or b"").decode("utf-8", "replace") for b in as_binary(batch.column("__text")).to_pylist()]
                ids = v.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(names))), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64())],
                    [*names, "ids", "n_tokens"],
                )
        v.rest()

    return arrow_map(source, run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`encode` and `decode` in one pass over one vocabulary: `keep` columns, ids, n_tokens and `decoded`."""
    fields = _kept(docs, keep, ("ids", "n_tokens", "decoded"))
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    source = docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, "__text", SLICE):
                ids = v.encode_batch([(b or b"").decode("utf-8", "replace") for b in as_binary(batch.column("__text")).to_pylist()])
                made = [pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(map(v.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], [*names, "ids", "n_tokens", "decoded"])
        v.rest()

    return arrow_map(source, run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `decoded`, the text of each row's ids; null ids are none."""
    fields = _kept(encoded, keep, ("decoded",))
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())])
    source = encoded.select(*(encoded[c] for c in names), encoded[ids].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, encoder=False)
        for whole in batches:
            for batch in slices(whole, "__ids"):
                out = [v.decode(b or b"") for b in as_binary(batch.column("__ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.string())], [*names, "decoded"])

    return arrow_map(source, run, schema)


def default_path() -> str:
    """The box's public vocabulary file; any other byte-level BPE file does as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
