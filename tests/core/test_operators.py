"""Hand-made cases and small simulators for order-dependent semantics."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import arrays, combine, graph, windows
from tessera.plans import bfs, kmeans, logreg, pagerank, preprocess
from tessera.sources import files, generators
from tessera.streaming import jobs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "value string").select(column(F.col("value")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "want"),
    [("1 2.5 -3e2 x 9", [1, 2.5, -300]), (".5\t7abc 8", [0.5, 7]), ("abc 1", []), ("", []), ("  4", [4])],
)
def test_parse_doubles(spark, line, want):
    assert one(spark, line, text.parse_doubles) == want


def test_split_words(spark):
    assert one(spark, "  a  b\tc ", text.split_words) == ["a", "b\tc"]
    assert one(spark, "", text.split_words) == []


def test_top_k_ties(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "word string, n long")
    assert [r["word"] for r in arrays.top_k(rows, 1).collect()] == ["b"]
    assert len(arrays.top_k(rows, 9).collect()) == 3


def simulate_slots(arrivals, tasks):
    """Open windows by task and slot; a later window of a slot closes the one before."""
    open_, out = {}, {}
    for w in arrivals:
        key = (w % tasks, w % 3)
        if key in open_ and open_[key] > w:
            continue
        open_[key] = w
        out[w] = out.get(w, 0) + 1
    return out


@pytest.mark.parametrize("tasks", [1, 2, 3, 5])
def test_late_rule(spark, tasks):
    rng = random.Random(tasks)
    cases = [[0, 3, 0], [0, 1, 2, 0], [5, 2], [max(0, i // 9 + rng.randrange(-5, 5)) for i in range(300)]]
    for case in cases:
        df = spark.createDataFrame([(i, w) for i, w in enumerate(case)], "i long, wnid long")
        kept = windows.keep_on_time(df, "i", "i", tasks, chunk=7)
        assert {r["wnid"]: r["n"] for r in kept.groupBy("wnid").agg(F.count("*").alias("n")).collect()} == simulate_slots(case, tasks)


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_bfs_root_rules(spark):
    for pairs, again in (([(1, 1), (1, 2)], 3), ([(1, 2), (2, 3), (3, 1), (7, 8)], 4), ([(1, 2), (1, 2), (2, 3)], 3)):
        e = edges_of(spark, pairs)
        seen = {r["v"]: r["level"] for r in bfs.search(e, 1).collect()}
        assert seen == {v: i for v, i in ((1, 0), (2, 1), (3, 2)) if v in {x for p in pairs for x in p} or v == 1}
        assert bfs.search(e, 1, root_again=True).count() == again


def test_pagerank_small(spark):
    """A dangling vertex, an isolated one and a doubled edge."""
    pairs = [(0, 1), (0, 1), (0, 2), (1, 2)]
    v = spark.range(4).select(F.col("id").alias("v"))
    rank = [0.85] * 4
    for _ in range(5):
        out = [0.85] * 4
        for a, b in pairs:
            out[b] += 0.15 * rank[a] / sum(p[0] == a for p in pairs)
        rank = out
    for pull in (False, True):
        got = {r["v"]: r["rank"] for r in pagerank.ranks(v, edges_of(spark, pairs), 5, pull=pull).collect()}
        assert [got[i] for i in range(4)] == pytest.approx(rank)


def test_remap_is_a_bijection(spark):
    v = spark.range(1003).select(F.col("id").alias("v"))
    for f in (lambda c: ids.remap_equal_vertex(c, 4, 1003), lambda c: ids.remap_chunk_round_robin(c, 4, 16), lambda c: ids.remap_chunk_round_robin(c, 4, 5000)):
        m = v.select("v", f(F.col("v")).alias("m")).select("v", "m", ids.part_of(F.col("m")).alias("p"), ids.offset_of(F.col("m")).alias("o"))
        assert m.select("m").distinct().count() == 1003
        assert m.where("p < 0 or p > 3").count() == 0
        assert m.where(ids.compose(F.col("p"), F.col("o")) != F.col("m")).count() == 0


def test_prepare_keeps_edges(spark, tmp_path):
    rng = random.Random(2)
    e = edges_of(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(300)])
    mapping = lambda c: ids.remap_chunk_round_robin(c, 4, 4)
    moved, index = preprocess.prepare(e, 4, mapping)
    assert preprocess.validate(preprocess.remap(e, mapping), moved)
    assert moved.withColumn("at", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("at").alias("n")).where("n > 1").count() == 0
    assert index.groupBy("part").agg(F.max("end").alias("e")).agg(F.sum("e")).first()[0] == 300
    preprocess.write(moved, index, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 300
    assert graph.csr_edges(preprocess.remap(e, mapping)).count() == 300


def test_kmeans_empty_cluster_and_tie(spark):
    p = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [4.0, 4.0])], "id long, x array<double>")
    got = {r["id"]: r["cluster"] for r in kmeans.assign(p, [[0.0, 1.0], [0.0, 1.0]]).collect()}
    assert got == {0: 0, 1: 0, 2: 0}  # a tie goes to the lowest
    centres, _ = kmeans.train(p, 2, 1)
    assert centres[1] == [0.0, 0.0]  # nothing was nearest: the origin


def test_logreg_zero_row(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], 1)], "id long, x array<double>, y int")
    assert logreg.predict(rows, [3.0, -1.0]).first()["pred"] == 1
    assert logreg.train(rows.limit(0), 2, 2) == [0.0, 0.0]


def test_generator(spark):
    a, c, m = generators.MULTIPLIER, generators.INCREMENT, 1 << 64
    want = {}
    for k in range(2):
        s = c + k
        for i in range(50):
            s = (a * s + c) % m
            want[k, i] = 10 * ((s & 0xFFFFFFFF) / 0xFFFFFFFF)
    got = {(r["instance"], r["i"]): r["v"] for r in generators.lcg_doubles(spark, 2, 50, 0.0, 10.0).collect()}
    assert got == pytest.approx(want)
    spark.dataSource.register(generators.LcgSource)
    assert spark.read.format("lcg").option("instances", 2).option("rows", 50).load().count() == 100
    assert len(generators.DICTIONARY) == 42


def test_binary_records(spark, tmp_path):
    (tmp_path / "e.tuples").write_bytes(b"".join(struct.pack("<II", i, 4_000_000_000 + i) for i in range(100)))
    fields = (("src", "uint32"), ("dst", "uint32"))
    e = files.read_binary_records(spark, str(tmp_path / "e.tuples"), fields)
    assert {tuple(r) for r in e.collect()} == {(i, 4_000_000_000 + i) for i in range(100)}
    assert files.pack_records(e, fields).agg(F.min(F.octet_length("record"))).first()[0] == 8


def test_fixed_width_and_config(spark, tmp_path):
    assert bytes(one(spark, "abc", lambda c: files.fixed_width(c, 5))) == b"abc\0\0"
    assert bytes(one(spark, "abcdefg", lambda c: files.fixed_width(c, 5))) == b"abcde"
    (tmp_path / "g.config").write_text("total_num_nodes = 7\ntotal_num_edges=9\n")
    assert files.read_config(spark, str(tmp_path / "g.config")) == {"total_num_nodes": "7", "total_num_edges": "9"}
    assert [ids.parse_bytes(s) for s in ("64k", "2G", "5")] == [65536, 2 << 30, 5]


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x y\nx\n")
    (folder / "b.txt").write_text("y x\n")
    stream = files.watch_text(spark, str(folder))
    counts = stream.select(F.explode(text.split_words(F.col("value"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    out = jobs.run_to_end(spark, counts, "watch", "complete", jobs._replace)
    assert {r["word"]: r["n"] for r in jobs._last(spark, out).collect()} == {"x": 3, "y": 2}


def test_combine(spark):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(500)], "k long, v double").repartition(5)
    got = {r["k"]: (r["s"], r["n"]) for r in combine.combine_per_key(df, "k", "v", combine.SumCount(), "s double, n long", limit=3).collect()}
    assert got == {k: (float(sum(range(k, 500, 7))), len(range(k, 500, 7))) for k in range(7)}
    assert combine.combine_per_key(df.limit(0), "k", "v", combine.SumCount(), "s double, n long").count() == 0


def test_slots_over_several_batches(spark, tmp_path):
    """Rows of a later batch arrive after all of those before, whatever their arrival number."""
    batches = [[(3, 1.0, 5), (0, 2.0, 4), (4, 1.0, 6)], [(3, 4.0, 1), (0, 8.0, 2), (6, 1.0, 9)], [(3, 16.0, 3), (6, 2.0, 0), (4, 5.0, 1)]]
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "wnid long, value double, arrival long").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if i < 2 else 0)  # files are taken in the order of their times
    want, held = {}, {}
    for rows in batches:
        for w, v, _ in sorted(rows, key=lambda r: r[2]):
            if held.get(w % 3, -1) <= w:
                held[w % 3] = w
                t, n = want.get(w, (0.0, 0))
                want[w] = (t + v, n + 1)
    arrivals = jobs.stream_of(spark, str(folder), 1).withColumn("tie", F.col("arrival"))
    assert {r["wnid"]: (r["total"], r["n"]) for r in jobs.stateful_window_sums(spark, arrivals).collect()} == want


def test_fold_of_nothing_and_much(spark):
    add, merge = (lambda a, r: a + r["id"]), (lambda a, b: a + b)
    assert arrays.fold(spark.range(0), lambda: 0, add, merge) == 0
    assert arrays.fold(spark.range(0, 1000, 1, 9), lambda: 0, add, merge, fan_in=2) == sum(range(1000))


def test_windows_in_integers(spark):
    big = (1 << 62) + 7
    row = spark.range(1).select(windows.fixed_window(F.lit(big), 10).alias("a"), windows.fixed_window(F.lit(-1), 10).alias("b"), windows.fixed_window(F.lit(-10), 10).alias("c"), ids.whole(F.lit(big), 2).alias("d")).first()
    assert tuple(row) == (big // 10, -1, -1, big // 2)


def test_kmeans_beyond_expressions(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 5), float(i % 7)]) for i in range(60)], "id long, x array<double>")
    want = (kmeans.assign(points, [[0.0, 0.0], [4.0, 6.0]]).orderBy("id").collect(), kmeans.cost(points, *kmeans.train(points, 3, 2)).first()[0])
    monkeypatch.setattr(kmeans, "EXPRESSION_VALUES", 0)
    assert kmeans.assign(points, [[0.0, 0.0], [4.0, 6.0]]).orderBy("id").collect() == want[0]
    assert kmeans.cost(points, *kmeans.train(points, 3, 2)).first()[0] == pytest.approx(want[1])
