"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest

from tessera.llm import bpe, decontaminate, langid, linededup, pii, quality, simjoin, suffix, urls, webp
import cases

BENCH = [(1, cases.PROSE), (2, None), (3, ""), (4, "one two")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


OPERATORS = {
    "lines": lambda s, d: linededup.drop_recurring(d),
    "suffix": lambda s, d: suffix.repeats(d),
    "decontaminate": lambda s, d: decontaminate.clean(d, bench(s)),
    "bpe": lambda s, d: bpe.encode(d, bpe.default_path()),
    "langid": lambda s, d: langid.predict(d, langid.learn(d)),
    "quality": lambda s, d: quality.classify(d, quality.train(d)),
    "simjoin": lambda s, d: simjoin.components(d),
    "webp": lambda s, d: webp.read_media(webp.to_media(d)),
    "pii": lambda s, d: pii.find(d, redact=True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_and_none(spark, name):
    out = OPERATORS[name](spark, cases.docs(spark)).collect()
    if name != "decontaminate":
        assert len(out) == len(cases.rows())
    assert OPERATORS[name](spark, cases.empty(spark)).collect() == []


def test_decontaminate_edges(spark):
    found = decontaminate.matches(cases.docs(spark), bench(spark))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(5, 1), (6, 1), (7, 1), (8, 1), (None, 1), (4, 4)}
    assert {r["doc_id"] for r in decontaminate.clean(cases.docs(spark), bench(spark)).collect()} == {0, 1, 2, 3, 9, 10, 11, 12, 13, 14}
    assert decontaminate.matches(cases.docs(spark), bench(spark).limit(0)).collect() == []
    assert decontaminate.matches(cases.docs(spark), bench(spark), block_bytes=60).count() == found.count()  # several blocks


def test_urls_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?q=1"), (5, "http://x.com/fr/"), (5, "http://x.com/fr/"), (6, "http://x.com"), (7, "h://" + "a" * 20000), (8, "http://org/\n?")]
    pages = spark.createDataFrame([(*r, *"cdefghij") for r in rows], "page_id long, url string, suffix string, label string, f_length string, __u string, host string, path string, rule string, verdict string")
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"))
    out = urls.judge(pages, rules)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in out.collect()}
    assert {(r["suffix"], r["label"], r["f_length"], r["__u"]) for r in out.collect()} == {tuple("cdef")}
    assert out.count() == len(rows)
    assert got[1] == got[2] == got[3] == ("", "", None)
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/")
    assert got[5] == ("x.com", "/fr/", "com/fr/") and got[6] == ("x.com", "", None) and got[8] == ("org", "/\n", "org/")
    assert {r["verdict"] for r in out.collect()} <= {"allow", "block"}
    assert urls.judge(pages.limit(0), rules).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, stage):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    docs = cases.docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = f(spark, docs, str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    out.collect()
    assert f(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 700)
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1500))
    docs = spark.createDataFrame([(1, text + text[:900]), (2, text[300:700])], "doc_id long, text string")
    out = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffix.repeats(docs).collect()}
    data, want = {1: text + text[:900], 2: text[300:700]}, {}
    every = [t[i : i + 200] for t in data.values() for i in range(len(t) - 199)]
    for k, t in data.items():
        cover = set()
        for i in range(len(t) - 199):
            if every.count(t[i : i + 200]) > 1:
                cover.update(range(i, i + 200))
        want[k] = cover
    assert {k: {i for a, b in v for i in range(a, b)} for k, v in out.items()} == want


def test_held_out_null(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(langid.held_out().alias("h")).first()["h"] is False
