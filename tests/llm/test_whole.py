"""Operators do the whole job on inputs that a limit once cut off."""

import collections
import random
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, frames, linededup, pii, quality, simjoin, suffix
from tessera.llm.textops import Rolling


def test_decontaminate_repeated_shingles(spark):
    """Long items at similarity 0.8 whose windows hold one shingle many times."""
    rng = random.Random(2)
    items, texts = [], []
    for i, (total, kept) in enumerate([(100, 90), (200, 178), (300, 267)] * 4):
        item = [f"w{i}x{j}" for j in range(total + 4)]
        items.append((i, " ".join(item)))
        run = [f"r{i}"] * (total - kept)
        text = item[: kept + 4] + run if i % 2 else run + item[total - kept :]
        texts.append(" ".join([*(f"p{rng.randrange(99)}" for _ in range(i)), *text]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(12)}
    assert all(r["similarity"] >= 0.8 for r in found)
    assert decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontaminate_by_brute_force():
    """Few different words: shingles repeat in items and windows."""
    rng = random.Random(6)
    bag = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    hits = 0
    for _ in range(60):
        item = [rng.choice("ab") for _ in range(rng.randrange(5, 60))]
        text = [x if rng.random() < 0.98 else "c" for x in item]
        cut = rng.randrange(len(text))
        text = [rng.choice("ab") for _ in range(rng.randrange(30))] + text[:cut] + [text[cut]] * rng.randrange(3) + text[cut:] + [rng.choice("ab") for _ in range(rng.randrange(30))]
        n = min(len(item), len(text))
        both = [bag(text[a : a + n]) for a in range(len(text) - n + 1)]
        scores = [sum((b & bag(item)).values()) / sum((b | bag(item)).values()) for b in both]
        top = max(range(len(scores)), key=scores.__getitem__)
        bench = decontaminate.Benchmark([(0, " ".join(item))])
        got = bench.rows(decontaminate.pa.array([" ".join(text)]), 0.8)
        assert [(s, a) for _, _, s, a, _ in got] == ([(scores[top], top)] if scores[top] >= 0.8 else [])
        hits += len(got)
    assert hits > 20


def test_pii_long_and_digitless_secrets(spark):
    rng = random.Random(3)
    pick = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k))
    secrets = [("secret=", pick(96)), ("token ", pick(82)), ("token = ", pick(300)), ("password=", "correct-horse-battery"), ("pwd: ", "mellow-orange-tin")]
    docs = spark.createDataFrame([(i, f"some words {a}{b} and more words") for i, (a, b) in enumerate(secrets)], "doc_id long, text string")
    rows = sorted(pii.find(docs, redact=True).collect())
    for r, (a, b) in zip(rows, secrets, strict=True):
        assert [(s["start"], s["end"]) for s in r["spans"]] == [(11 + len(a), 11 + len(a + b))]
        assert r["redacted"] == f"some words {a}[{r['spans'][0]['kind']}] and more words"
    plain = ["note: tomorrow we meet", "-" * 90, "the state-of-the-art-methods-here", "see https://example.org/some/long/path/of/words/without/any/number", "DONAUDAMPFSCHIFFFAHRT und Donaudampfschifffahrt"]
    assert all(not pii.detector().spans(t, []) for t in plain)


def test_pii_examples_hold_long_and_digitless_candidates():
    rows = pii.examples(1500, seed=998)
    for kind in ("secret", "credential"):
        own = [(t, s, y) for t, s, y in rows if s[0] == kind]
        for part in ([x for x in own if x[1][2] - x[1][1] > 64], [x for x in own if not any(c.isdigit() or c == "@" for c in x[0])]):
            assert {y for *_, y in part} == {0, 1}
            model = pii.detector()
            hit = np.array([p >= model.thresholds[kind] for p in model.model.probability(np.array([pii.describe(t, s) for t, s, _ in part]))])
            truth = np.array([y for *_, y in part], dtype=bool)
            assert (hit & truth).sum() >= 0.9 * truth.sum() and (hit & ~truth).sum() <= 0.05 * hit.sum()


def test_near_copies_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a + " end"), (3, c), (3, c), (None, d), (None, d + " end"), (4, ""), (4, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sum(r in ((None, d), (None, d + " end")) for r in got) == 1  # one of two null ids
    rest = collections.Counter(r for r in got if not (r[1] or "").startswith(d))
    assert rest == collections.Counter([(1, a), (2, b), (3, c), (4, ""), (4, ""), (None, None), (None, None)])


def near_copies(rng, groups, size):
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(9999)}" for _ in range(150)]
        for _ in range(size):
            some = list(base)
            some[rng.randrange(150)] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(some))
    return texts


def test_components_with_colliding_names(spark):
    """All sets share four first names: second hashes tell them apart."""
    docs = spark.createDataFrame(list(enumerate(near_copies(random.Random(1), 12, 3))), "doc_id long, text string")
    want = {tuple(r) for r in simjoin.components(docs).collect()}
    assert {tuple(r) for r in simjoin.components(docs, name_bits=2).collect()} == want and len({c for *_, c in want}) == 12


def test_components_of_frequent_signatures(spark, monkeypatch):
    """Signatures dealt out in parts give the same links."""
    docs = spark.createDataFrame(list(enumerate(near_copies(random.Random(2), 4, 30))), "doc_id long, text string")
    want = {tuple(r) for r in simjoin.components(docs).collect()}
    monkeypatch.setattr(simjoin, "PROBES", 1)
    calls = []
    signed = simjoin._signed
    monkeypatch.setattr(simjoin, "_signed", lambda *a: (calls.append(len(a[-1])), signed(*a))[1])
    assert {tuple(r) for r in simjoin.components(docs).collect()} == want and calls[0] > 0 and len({c for *_, c in want}) == 4


def test_second_context_hash_where_the_first_collides():
    """Thue-Morse strings agree in any polynomial hash modulo 2**64."""
    word = np.array([bin(i).count("1") & 1 for i in range(4096)], dtype=np.uint8)
    a, b = word + np.uint8(97), np.uint8(98) - word
    ends = (np.array([0]), np.array([4096]))
    assert Rolling(a).ranges(*ends) == Rolling(b).ranges(*ends)
    rows = [suffix.anchors(x, np.array([0, 4096]), 4096, 48) for x in (a, b)]
    assert all(len(r[0]) == 1 for r in rows) and rows[0][5][0] != rows[1][5][0]


def test_suffix_frequent_anchors(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(90))
    texts = [f"{' '.join(f'w{rng.randrange(9999)}' for _ in range(30))} {passage}" for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    row = lambda r: (r["doc_id"], r["n_bytes"], bytes(r["kept"]))
    want = set(map(row, suffix.repeats(docs).collect()))
    monkeypatch.setattr(suffix, "PROBES", 1)
    assert set(map(row, suffix.repeats(docs).collect())) == want and all(len(k) < n for _, n, k in want)


def test_quality_sample_does_not_depend_on_partitions(spark):
    texts = [(None if i % 3 else i, f"Some words of text number {i % 50} stand here. " * (1 + i % 5) + "!!! " * (i % 4)) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (quality.train(docs.repartition(n), rows=100) for n in (3, 7))
    assert np.allclose(a.weights, b.weights) and a.posterior == b.posterior


def test_lines_of_rows_with_one_id(spark):
    """A recurring line goes from the rows that hold it, not from others with the same id."""
    line = "the same long line stands here"
    docs = spark.createDataFrame([(1, line), (2, line), (3, line), (3, "a line of its own here now"), (None, line), (None, "x\n" + line)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["text"]) for r in linededup.drop_recurring(docs).collect())
    # a null id comes first; its two rows count as one document
    assert sum(n for (i, t), n in got.items() if t and line in t) == 1
    assert got[3, "a line of its own here now"] == 1 and got[1, ""] == got[2, ""] == got[3, ""] == 1


def test_decontaminate_memory_of_far_hits():
    """One item at both ends of a long text: bit sums are formed for its windows only."""
    import tracemalloc

    rng = random.Random(7)
    item = " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    text = f"{item} {' '.join(f'v{i}' for i in range(200_000))} {item}"
    bench = decontaminate.Benchmark([(0, item)])
    tracemalloc.start()
    found = bench.rows(decontaminate.pa.array([text]), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(s, a) for _, _, s, a, _ in found] == [(1.0, 0)] and peak < 150e6


@pytest.mark.parametrize("spread", [4, 1000])
def test_suffix_large_anchor_in_parts(spark, monkeypatch, spread):
    """Contexts of one large anchor go to the distributed sort only where they share more than the anchor."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    hash_of = lambda g: int(Rolling(np.frombuffer(g.encode(), np.uint8)).grams(4)[0])
    gram = min((letters(4) for _ in range(3000)), key=hash_of)
    same = letters(9) + gram + letters(9)
    texts = [letters(25) + (same if i % 9 == 0 else letters(9) + gram + letters(9)) + letters(25) for i in range(63)]
    texts += [texts[3], texts[4][5:50] + letters(3)]
    starts = collections.Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    want = []
    for i, t in enumerate(texts):
        gone = {j for a in range(len(t) - 19) if starts[t[a : a + 20]] > 1 for j in range(a, a + 20)}
        want.append((i, "".join(c for j, c in enumerate(t) if j not in gone)))
    wide, calls = suffix._sorted_wide, []
    monkeypatch.setattr(suffix, "_sorted_wide", lambda *a: (calls.append(1), wide(*a))[1])
    monkeypatch.setattr(suffix, "SPREAD", spread, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffix.repeats(docs, length=20, k=4, block=600).collect())
    assert got == want and len(calls) == (spread > 100)


def test_packed_checkpoint(spark):
    rows = spark.range(50_000).selectExpr("id", "cast(id % 7 as byte) b", "struct(id x, cast(null as string) y) s", "array(id) a")
    held = frames.packed_checkpoint(rows)
    assert held.schema.simpleString() == rows.schema.simpleString() and held.exceptAll(rows).isEmpty() and held.count() == 50_000
    assert frames.packed_checkpoint(rows.where("id < 0")).count() == 0


def test_short_signatures_lose_no_link():
    """Signatures take 48 bits each, and similar sets still share one."""
    rng = np.random.default_rng(3)
    for size in (30, 120, 700):
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        few = size // 12  # differences on each side: similarity 0.84 or more
        sets = [np.unique(np.concatenate([rng.permutation(base)[few:], rng.integers(0, 1 << 63, few).astype(np.uint64)])) for _ in range(12)]
        found = simjoin.signatures([base, *sets], 80, 100)
        assert all(len(x) and x.min() >= 0 and x.max() < 1 << 48 for x in found)
        assert all(len(np.intersect1d(found[0], x)) for x in found[1:])


def test_release_gives_up_waiting_java_objects():
    given, waited = [], []
    client = SimpleNamespace(garbage_collect_object=lambda target, enqueue: given.append((target, enqueue)))
    client.finalizer_deque = collections.deque([(client, "o1"), (client, "o2")])
    system = SimpleNamespace(gc=lambda: waited.append(len(client.finalizer_deque)))
    context = SimpleNamespace(_gateway=SimpleNamespace(_gateway_client=client), _jvm=SimpleNamespace(System=system))
    frames.release(SimpleNamespace(sparkContext=context))
    assert waited == [0] and sorted(given) == [("o1", False), ("o2", False)]


def test_signatures_with_the_same_nodes_are_held_once(spark):
    sets = {(1, 2): 40, (1, 2, 3): 30, (2, 3): 1, (4,): 20}  # nodes: how many signatures have them
    rows = []
    for nodes, n in sets.items():
        rows += [(len(rows) * 7 + i, -1, node) for i in range(n) for node in nodes]
    for part in (0, 1):  # a heavy signature's parts hold only some of its nodes
        rows += [(900_000, part, node) for node in (1, 2)]
    got = simjoin._shared(spark.createDataFrame(rows, "sig long, part byte, node long").coalesce(1)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["sig"], []).append(r["node"])
    by_sig = {}
    for sig, _, node in rows:
        by_sig.setdefault(sig, []).append(node)
    want = {tuple(sorted(v)) for v in by_sig.values() if len(v) > 1}
    assert {tuple(sorted(v)) for v in groups.values()} == want  # none is lost
    assert len(got) < 100 < sum(len(v) for v in by_sig.values() if len(v) > 1)


def test_signatures_without_a_possible_pair_are_settled(spark):
    rng = np.random.default_rng(5)
    sets = {1: np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)), 3: np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))}
    sets[2] = np.unique(np.concatenate([sets[1][10:], rng.integers(0, 1 << 63, 10).astype(np.uint64)]))
    rows = [(sig, node, node, 2, len(sets[node]), bytearray(simjoin.coarse(simjoin.sketch(sets[node])))) for sig, nodes in ((7, (1, 2)), (8, (1, 3)), (9, (2, 3))) for node in nodes]
    members = spark.createDataFrame(rows, "sig long, node long, comp long, m long, size long, sketch binary")
    assert [tuple(r) for r in simjoin._across(members, 80, 100, None).collect()] == [(7,)]
    for a, b in ((1, 2), (1, 3)):
        full, less = (simjoin.folded([f(sets[a]), f(sets[b])]) for f in (simjoin.sketch, lambda s: simjoin.coarse(simjoin.sketch(s))))
        assert np.bitwise_count(less[0] ^ less[1]).sum() <= np.bitwise_count(full[0] ^ full[1]).sum()
