"""Personal data: candidate spans, boosted trees on format and context, calibrated thresholds.

Exact matchers of four kinds (email, ip, card, phone) give base spans, which
always stay.  High-recall generators propose further, overlapping spans; trees
trained here on generated examples score each by its format and its context,
Platt scaling on held-out examples calibrates the scores, and each generator's
threshold is the lowest that keeps the wanted precision on held-out examples.
Where accepted spans overlap, the higher score stays, then the longer, then the
earlier.

Defined results: null text is the empty text (no spans); spans are code points,
end exclusive; texts of any length are searched whole, each generator and the base
matchers in linear time; repeated rows give repeated results; an empty table gives
an empty result; only `keep` columns are carried, and spans and redacted win over
kept ones of the same name.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import boost
from tessera.llm.frames import arrow_map
from tessera.llm.textops import as_binary, slices

BASE_KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

TRIGGER = re.compile(r"[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Whole runs of digit groups between single dots; an ip is every four groups of one, in order.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Anchored at each @: the local part reaches back to where its characters, or the last match, begin."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        else:
            done = max(done, at)  # no later local part crosses an @
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four exact matchers, by start, then kind."""
    if not TRIGGER.search(text):
        return []
    out = list(_emails(text))
    for m in DOTTED.finditer(text):
        groups, at = m.group().split("."), m.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0]), s[2]))


#: High-recall generators, tried on any text: no candidate depends on what else its text holds.
GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}(?![A-Za-z0-9_/+-])"),
    "credential": re.compile(r"(?<=[=:])[ ]?[\"']?[A-Za-z0-9!#$%^&*_/+.-]{6,}"),
    "id": re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"),
    "number": re.compile(r"(?<![0-9A-Za-z.-])\(?[0-9][0-9 ()/-]{6,18}[0-9](?![0-9A-Za-z.-])"),
}
KINDS = (*BASE_KINDS, *GENERATORS)
CONTEXT = ("password", "passwd", "pwd", "secret", "token", "key", "api", "auth")
CALL = ("phone", "tel", "call", "mobile", "fax")
IDENTITY = ("ssn", "iban", "passport", "account", "card", "id")
WORDS_BEFORE = 24


def candidates(text: str) -> Iterator[Span]:
    for kind, pattern in GENERATORS.items():
        for m in pattern.finditer(text):
            start = m.start() + len(m.group()) - len(m.group().lstrip(" \"'"))
            if start < m.end():
                yield kind, start, m.end()


def describe(text: str, span: Span) -> list[int]:
    """Binned features of a candidate's format and of the words before it."""
    kind, start, end = span
    s, before = text[start:end], text[max(0, start - WORDS_BEFORE) : start].lower()
    n = len(s)
    digits, upper, lower = (sum(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    counts = Counter(s)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    words = re.findall(r"[a-z]+", before)[-3:]
    named = lambda group: int(any(w in group for w in words))
    return [
        list(GENERATORS).index(kind),
        min(n // 4, 14 + (n >= 60) + (n > 64) + (n > 128) + (n > 256)),
        min(10 * digits // n, 10),
        min(10 * upper // n, 10),
        min(10 * lower // n, 10),
        min(int(2 * entropy), 12),
        min(10 * turns // n, 10),
        int(re.fullmatch(r"[0-9a-f]+", s) is not None),
        min(sum(c in " ()/-" for c in s), 6),
        named(CONTEXT),
        named(CALL),
        named(IDENTITY),
        int(before.rstrip(" \"'")[-1:] in ("=", ":")),
        int(re.match(r"[A-Z]{4}[A-Z0-9]{8,}$", s) is not None),
        int(re.match(r"(19|20)[0-9]{2}[-/]|[0-9]{1,2}[-/][0-9]{1,2}[-/](19|20)", s) is not None),
    ]


def examples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Generated texts with candidate spans and labels: private data and look-alikes."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(lower, rng.randint(2, 9))
    good = [
        lambda: "AKIA" + pick(upper + "234567890", 16),
        lambda: f"password={pick('0123456789abcdef', rng.randint(12, 24))}",
        lambda: f'token = "{pick("0123456789abcdef", rng.choice((32, 40, 64)))}"',
        lambda: f"api_key: {pick(lower + upper + digit, rng.randint(20, 40))}",
        lambda: f"secret={pick(lower + upper + digit, rng.randint(10, 30))}",
        lambda: f"{rng.choice(('password', 'passwd', 'pwd'))}{rng.choice(('=', ': '))}{'-'.join(word() for _ in range(rng.randint(3, 5)))}",
        lambda: f"{rng.choice(('secret', 'token', 'auth', 'api_key'))}{rng.choice(('=', ': '))}{pick(rng.choice((lower, lower + upper, lower + upper + digit, '0123456789abcdef')), rng.randint(65, 400))}",
        lambda: f"{rng.choice(('secret', 'token', 'key'))} {pick(lower + upper + digit, rng.randint(16, 200))}",
        lambda: f"ssn {pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}",
        lambda: f"iban {pick(upper, 2)}{pick(digit, 2)} {pick(digit, 4)} {pick(digit, 4)} {pick(digit, 4)} {pick(digit, 2)}",
        lambda: f"call ({pick(digit, 3)}) {pick(digit, 3)}-{pick(digit, 4)}",
        lambda: f"phone {pick(digit, 3)}-{pick(digit, 3)}-{pick(digit, 4)}",
    ]
    bad = [
        lambda: f"{word()}-{word()}-{word()}-{word()}-{word()}{rng.randint(0, 99)}",
        lambda: pick(lower, rng.randint(16, 40)) + str(rng.randint(0, 9)),
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1900, 2010)}-{rng.randint(2011, 2030)}",
        lambda: f"version: {rng.randint(1, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}",
        lambda: f"pages: {rng.randint(100, 900)}-{rng.randint(901, 2000)}",
        lambda: f"isbn {pick(digit, 1)}-{pick(digit, 4)}-{pick(digit, 4)}-{pick(digit, 1)}",
        lambda: f"{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {word()}",
        lambda: f"{word()}: {word()}{word()} {rng.randint(1, 9)}",
        lambda: f"colour={word()}{rng.randint(0, 9)}",
        lambda: f"order {pick(digit, 8)}",
        lambda: f"{word()}{rng.choice((': ', '=', ':'))}{pick(lower, rng.randint(6, 14))}",
        lambda: f"{rng.choice(CONTEXT)} {pick(lower, rng.randint(16, 24))}",
        lambda: f"{word()} {rng.choice('-/_').join(word() for _ in range(rng.randint(4, 40)))}",
        lambda: f"https://{word()}.org/{'/'.join(word() for _ in range(rng.randint(2, 20)))}",
        lambda: f"{word()} {rng.choice('-_+/a0') * rng.randint(16, 200)}",
        lambda: f"{word()} {pick(upper, rng.randint(16, 40))}",
        lambda: f"{word()} {pick(upper, 1)}{pick(lower, rng.randint(15, 40))}",
        lambda: f"{word()} {pick('acgt', rng.randint(65, 400))}",
        lambda: f"{word()} {pick(digit, 12)}",
        lambda: f"/{word()}/{word()}/{word()}{rng.randint(0, 99)}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        head, body = " ".join(word() for _ in range(4)) + " ", rng.choice(good if label else bad)()
        text = f"{head}{body} {word()} {word()}"
        value = (len(head) + max(body.find("="), body.find(":"), 0), len(head) + len(body))
        for span in candidates(text):
            inside = span[1] >= len(head) and span[2] <= value[1] + 1
            out.append((text, span, int(label and inside)))
    return out


class Taken:
    """Places of a text covered by spans, as sorted runs that do not touch."""

    def __init__(self, spans: Sequence[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, span: Span) -> bool:
        i = bisect.bisect_right(self.ends, span[1])  # the first run that ends behind the span's start
        return i == len(self.starts) or self.starts[i] >= span[2]

    def add(self, span: Span) -> None:
        """Covers a free span."""
        i = bisect.bisect_right(self.ends, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


class Detector:
    """The trained model and each generator's threshold."""

    def __init__(self, n: int = 6000, seed: int = 11, precision: float = 0.995):
        parts = []
        for part in range(3):  # to fit, to calibrate, to choose thresholds
            rows = examples(n // 3, seed + part)
            x = np.array([describe(t, s) for t, s, _ in rows], dtype=np.int64)
            parts.append((x, np.array([y for *_, y in rows], dtype=float)))
        (x, y), (cx, cy), (tx, ty) = parts
        self.model = boost.calibrate(boost.fit(x, y, 1 - y, trees=30), cx, cy, 1 - cy)
        p = self.model.probability(tx)
        self.thresholds = {}
        for i, kind in enumerate(GENERATORS):
            own = tx[:, 0] == i
            order = np.argsort(-p[own], kind="stable")
            scores, hits = p[own][order], np.cumsum(ty[own][order])
            good = np.flatnonzero(hits / np.arange(1, len(hits) + 1) >= precision)
            self.thresholds[kind] = max(0.5, float(scores[good[-1]])) if len(good) else 2.0

    def spans(self, text: str, base: Sequence[Span]) -> list[tuple[Span, float]]:
        taken = Taken(base)
        found = [s for s in candidates(text) if taken.free(s)]
        if not found:
            return []
        p = self.model.probability(np.array([describe(text, s) for s in found], dtype=np.int64))
        ranked = sorted(((s, float(q)) for s, q in zip(found, p, strict=True) if q >= self.thresholds[s[0]]), key=lambda x: (-x[1], x[0][1] - x[0][2], x[0][1], x[0][0]))
        out: list[tuple[Span, float]] = []
        taken = Taken()
        for s, q in ranked:
            if taken.free(s):
                taken.add(s)
                out.append((s, q))
        return sorted(out, key=lambda x: (x[0][1], x[0][2]))


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))


def find(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), redact: bool = False) -> DataFrame:
    """`keep` columns and `spans` of each whole text; with `redact` also the text with [kind] for each span."""
    made = ["spans", *(["redacted"] if redact else [])]
    fields = [docs.schema[c] for c in keep if c not in made]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("spans", SPAN), *([T.StructField("redacted", T.StringType())] if redact else [])])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                rows, texts = [], []
                for raw in as_binary(batch.column("__text")).to_pylist():
                    t = (raw or b"").decode("utf-8", "replace")
                    base = base_spans(t)
                    spans = [(s, 1.0, True) for s in base]
                    spans += [(s, q, False) for s, q in detector().spans(t, base)]
                    spans.sort(key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
                    rows.append([{"kind": s[0], "start": s[1], "end": s[2], "base": b, "score": q} for s, q, b in spans])
                    if redact:
                        out, at = [], 0
                        for (k, a, b), *_ in spans:
                            if a >= at:
                                out += [t[at:a], f"[{k}]"]
                            at = max(at, b)
                        texts.append("".join([*out, t[at:]]))
                arrays = [pa.array(rows, kind), *([pa.array(texts, pa.string())] if redact else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *arrays], [*names, *made])

    return arrow_map(docs.select(*(docs[c] for c in names), docs[text].cast("binary").alias("__text")), run, schema)


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
