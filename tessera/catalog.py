"""Registered queries over the engine's operators, each with its DuckDB oracle.

The graph fixture takes an edge from each line item: from the order key modulo the
number of parts to the part key.  Results that are doubles are rounded to 6 decimals on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import ids, text, vectors
from tessera.operators import arrays, combine, graph, windows
from tessera.plans import bfs, kmeans, logreg, pagerank, preprocess, wordcount
from tessera.sources import files, generators
from tessera.streaming import jobs
from tessera.streaming.pipeline import DoFn, FixedWindows, ParDo, PCollection, Shuffle, WindowedCombine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR_US = 3_600_000_000
PARTS, CHUNK = 4, 64
DIM, K = 64, 3


def query(sql: str | None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str, name: str | None = None):
    return F.round(F.col(column), 6).alias(name or column)


# Text ---------------------------------------------------------------------------------

LINES = "lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)"
WORDS = LINES + ", words AS (SELECT word FROM (SELECT unnest(string_split(value, ' ')) AS word FROM lines) WHERE word <> '')"


def _words(spark, sf_dir):
    return wordcount.words(wordcount.lines(table(spark, sf_dir, "documents")))


@query(f"WITH {LINES} SELECT value, count(*) AS n FROM lines GROUP BY value")
def text_lines_scan(spark, sf_dir):
    return wordcount.lines(table(spark, sf_dir, "documents")).groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT length(word) AS size, count(*) AS n, count(DISTINCT word) AS different FROM words GROUP BY 1")
def split_words(spark, sf_dir):
    counts = wordcount.counts(_words(spark, sf_dir))  # words meet once, combined before the shuffle
    return counts.groupBy(F.length("word").cast("long").alias("size")).agg(F.sum("n").alias("n"), F.count("*").alias("different"))


@query(f"WITH {WORDS} SELECT word, count(*) AS n FROM words GROUP BY word")
def wordcount_all(spark, sf_dir):
    return wordcount.counts(_words(spark, sf_dir))


TOP = f"WITH {WORDS} SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word DESC LIMIT 10"


@query(TOP)
def wordcount_topk(spark, sf_dir):
    return arrays.top_k(wordcount_all(spark, sf_dir), 10)


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", windows.micros(F.col("ts"))).withColumn("wnid", windows.fixed_window(F.col("us"), HOUR_US))


EVENTS = f"e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // {HOUR_US} AS wnid FROM events)"


@query(
    f"WITH {EVENTS}, c AS (SELECT wnid, event_type AS word, count(*) AS n FROM e GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY wnid ORDER BY n DESC, word DESC) AS r FROM c) SELECT wnid, word, n FROM r WHERE r <= 2"
)
def wordcount_topk_windowed(spark, sf_dir):
    return wordcount.top_by_window(_events(spark, sf_dir).select("wnid", F.col("event_type").alias("word")), 2)


@query("SELECT event_id, round(value, 6) AS v FROM events")
def parse_doubles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("line"))
    return e.select("event_id", F.explode(text.parse_doubles(F.col("line"))).alias("v")).select("event_id", r6("v"))


@query(f"WITH {EVENTS} SELECT event_id, us, wnid FROM e")
def assign_ts_window(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "us", "wnid")


@query(f"WITH {EVENTS} SELECT wnid, round(sum(value), 6) AS total, count(*) AS n, round(sum(value) / count(*), 6) AS average FROM e GROUP BY wnid")
def window_sum_count_avg(spark, sf_dir):
    s = windows.sum_count(_events(spark, sf_dir))
    return s.select("wnid", r6("total"), "n", F.round(F.col("total") / F.col("n"), 6).alias("average"))


LATE = (
    f"WITH {EVENTS}, a AS (SELECT *, event_id + (event_id * 7919) % 101 AS arrival FROM e), "
    "m AS (SELECT *, max(wnid) OVER (PARTITION BY wnid % 3 ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) "
    "SELECT wnid, round(sum(value), 6) AS total, count(*) AS n FROM m WHERE top IS NULL OR top <= wnid GROUP BY wnid"
)


def _arrivals(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("arrival", F.col("event_id") + (F.col("event_id") * 7919) % 101)


@query(LATE)
def window_sum_late_drop(spark, sf_dir):
    kept = windows.keep_on_time(_arrivals(spark, sf_dir), "arrival", "event_id", tasks=1, chunk=4096)
    return windows.sum_count(kept).select("wnid", r6("total"), "n")


@query(
    f"WITH {EVENTS}, s AS (SELECT wnid, round(sum(value), 6) AS t, count(*) AS n FROM e GROUP BY wnid) "
    "SELECT wnid, 'wnid: ' || wnid || '   sum: ' || printf('%.6f', t) || '  count: ' || n || '   average: ' || printf('%.6f', t / n) AS line FROM s"
)
def window_result_format(spark, sf_dir):
    s = windows.sum_count(_events(spark, sf_dir)).withColumn("total", F.round("total", 6))
    return s.select("wnid", text.format_window(F.col("wnid"), F.col("total"), F.col("n")).alias("line"))


@query(f"WITH {EVENTS} SELECT event_id, 'ts = ' || us || '  e = ' || printf('%.6f', value) AS line FROM e")
def timestamped_format(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", text.format_timestamped(F.col("us"), F.col("value")).alias("line"))


@query(
    f"WITH {EVENTS}, c AS (SELECT wnid, event_type AS word, count(*) AS n FROM e GROUP BY 1, 2) "
    "SELECT wnid, 'id = ' || wnid || chr(10) || string_agg('  ' || word || ': ' || n || chr(10), '' ORDER BY word) AS body FROM c GROUP BY wnid"
)
def word_map_format(spark, sf_dir):
    c = _events(spark, sf_dir).groupBy("wnid", F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    return c.groupBy("wnid").agg(F.collect_list(F.struct("word", "n")).alias("m")).select("wnid", text.format_word_map(F.col("wnid"), F.col("m")).alias("body"))


# Arrays and graph ---------------------------------------------------------------------

E = "v AS (SELECT count(*) AS n FROM part), e AS (SELECT l_orderkey % v.n AS src, l_partkey AS dst FROM lineitem, v)"
VERT = ", vert AS (SELECT unnest(range(v.n)) AS v FROM v)"


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % F.lit(n)).alias("src"), F.col("l_partkey").alias("dst")), n


def _graph(spark, sf_dir):
    edges, n = _edges(spark, sf_dir)
    return spark.range(n).select(F.col("id").alias("v")), edges


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS price FROM lineitem")
def array_map(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return arrays.array_map(t, l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), price=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6))


@query(f"WITH {E} SELECT max(greatest(src, dst)) AS max_id FROM e")
def array_reduce_max(spark, sf_dir):
    return arrays.max_id(_edges(spark, sf_dir)[0])


def _add_gap(acc, row):
    gap = abs(row["src"] - row["dst"])
    return max(acc[0], gap), acc[1] + gap


@query(f"WITH {E} SELECT max(abs(src - dst)) AS widest, CAST(sum(abs(src - dst)) AS BIGINT) AS total FROM e")
def array_fold_merge(spark, sf_dir):
    """A user's fold and merge: the widest gap between ends, and the sum of the gaps."""
    found = arrays.fold(_edges(spark, sf_dir)[0], lambda: (0, 0), _add_gap, lambda a, b: (max(a[0], b[0]), a[1] + b[1]))
    return spark.createDataFrame([found], "widest long, total long")


@query(f"WITH {E} SELECT count(*) AS size FROM e")
def array_global_size(spark, sf_dir):
    return arrays.global_size(_edges(spark, sf_dir)[0])


@query(f"WITH {E} SELECT bit_xor(CAST(src + (dst << 32) AS BIGINT)) AS checksum FROM e")
def array_checksum(spark, sf_dir):
    return arrays.checksum(_edges(spark, sf_dir)[0])


@query(f"WITH {E}, p AS (SELECT src // {CHUNK} % {PARTS} AS part, count(*) AS n FROM e GROUP BY 1) SELECT min(n) AS min_rows, round(avg(n), 6) AS avg_rows, max(n) AS max_rows, round(max(n) / avg(n), 6) AS imbalance FROM p")
def array_stats_imbalance(spark, sf_dir):
    moved = _remapped(spark, sf_dir)
    return arrays.balance(moved, ids.part_of(F.col("src"))).select("min_rows", r6("avg_rows"), "max_rows", r6("imbalance"))


def _rr(c: str) -> str:
    return f"((({c} // {CHUNK}) % {PARTS}) << 30) + ({c} // {CHUNK}) // {PARTS} * {CHUNK} + {c} % {CHUNK}"


def _eq(c: str) -> str:
    size = f"((v.n + {PARTS - 1}) // {PARTS})"
    return f"(({c} // {size}) << 30) + {c} % {size}"


R = E + f", r AS (SELECT CAST({_rr('src')} AS BIGINT) AS src, CAST({_rr('dst')} AS BIGINT) AS dst FROM e)"


def _remapped(spark, sf_dir):
    return preprocess.remap(_edges(spark, sf_dir)[0], lambda c: ids.remap_chunk_round_robin(c, PARTS, CHUNK))


@query(f"WITH {R} SELECT src, dst, count(*) AS n FROM r GROUP BY src, dst")
def remap_chunk_roundrobin(spark, sf_dir):
    return _remapped(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT CAST({_eq('src')} AS BIGINT) AS src, CAST({_eq('dst')} AS BIGINT) AS dst, count(*) AS n FROM e, v GROUP BY 1, 2")
def remap_equal_vertex(spark, sf_dir):
    edges, n = _edges(spark, sf_dir)
    return preprocess.remap(edges, lambda c: ids.remap_equal_vertex(c, PARTS, n)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    f"WITH {E}, d AS (SELECT src AS v, count(*) AS d FROM e GROUP BY src), s AS (SELECT v, (CAST(sum(d) OVER (ORDER BY v) AS BIGINT) - d) * {PARTS} // (SELECT count(*) FROM e) AS share FROM d), "
    f"b AS (SELECT i, coalesce((SELECT min(s.v) FROM s WHERE s.share >= i), v.n) AS low FROM range(1, {PARTS}) r(i), v), p AS (SELECT src, (SELECT count(*) FROM b WHERE low <= src) AS part FROM e) "
    "SELECT part, count(*) AS edges, min(src) AS low, max(src) AS high FROM p GROUP BY part"
)
def remap_equal_edges(spark, sf_dir):
    """Ranges of vertices with about equal numbers of out-edges."""
    edges, n = _edges(spark, sf_dir)
    bounds = preprocess.equal_edge_bounds(edges, n, PARTS)
    owned = edges.select("src", preprocess.owner(F.col("src"), bounds).cast("long").alias("part"))
    return owned.groupBy("part").agg(F.count("*").alias("edges"), F.min("src").alias("low"), F.max("src").alias("high"))


@query(f"WITH {E}{VERT} SELECT (vert.v >= v.n // 4)::BIGINT + (vert.v >= v.n // 2)::BIGINT + (vert.v >= 3 * v.n // 4)::BIGINT AS part, count(*) AS n FROM vert, v GROUP BY 1")
def range_ownership(spark, sf_dir):
    vertices, _ = _graph(spark, sf_dir)
    n = vertices.count()
    return vertices.groupBy(preprocess.owner(F.col("v"), [0, n // 4, n // 2, 3 * n // 4, n]).cast("long").alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT DISTINCT src AS vid, src >> 30 AS part, src & 1073741823 AS off FROM r")
def decompose_vid(spark, sf_dir):
    return _remapped(spark, sf_dir).select(F.col("src").alias("vid"), ids.part_of(F.col("src")).alias("part"), ids.offset_of(F.col("src")).alias("off")).distinct()


@query(f"WITH {R} SELECT src >> 30 AS part, count(*) AS n, bit_xor(src) AS xor_src, bit_xor(dst) AS xor_dst FROM r GROUP BY 1")
def repartition_counts(spark, sf_dir):
    moved = arrays.repartition_by(_remapped(spark, sf_dir), ids.part_of(F.col("src")), PARTS)
    return moved.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor("src").alias("xor_src"), F.bit_xor("dst").alias("xor_dst"))


@query(
    f"WITH {R}, top AS (SELECT max(greatest(src & 1073741823, dst & 1073741823)) AS t FROM r), p AS (SELECT DISTINCT src >> 30 AS part FROM r), "
    "g AS (SELECT part, unnest(range(top.t + 1)) AS off FROM p, top), d AS (SELECT src >> 30 AS part, src & 1073741823 AS off, count(*) AS d FROM r GROUP BY 1, 2), "
    "f AS (SELECT part, off, coalesce(d, 0) AS d FROM g LEFT JOIN d USING (part, off)), "
    'w AS (SELECT part, off, d, CAST(sum(d) OVER (PARTITION BY part ORDER BY off) AS BIGINT) AS "end" FROM f) SELECT part, off, "end" - d AS "begin", "end" FROM w'
)
def sorted_edges_csr_index(spark, sf_dir):
    return graph.csr_index(_remapped(spark, sf_dir)).select("part", "off", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query(f"WITH {R} SELECT src >> 30 AS part, row_number() OVER (PARTITION BY src >> 30 ORDER BY src, dst) - 1 AS pos, dst FROM r")
def csr_edges(spark, sf_dir):
    return graph.csr_edges(_remapped(spark, sf_dir))


@query(f"WITH {R}, p AS (SELECT src >> 30 AS part, count(*) AS edges, bit_xor(dst) AS xor_dst FROM r GROUP BY 1) SELECT part, edges, xor_dst, edges AS last_end, 0 AS inversions FROM p")
def graph_preprocess(spark, sf_dir):
    """Remap, repartition, local sort and index: per partition its edges, the index's last end and edges out of order."""
    edges, index = preprocess.prepare(_edges(spark, sf_dir)[0], PARTS, lambda c: ids.remap_chunk_round_robin(c, PARTS, CHUNK))
    # the row number as it lies in the partition against the number in sorted order
    w = Window.partitionBy("part").orderBy("src", "dst")
    placed = edges.withColumn("lies", F.monotonically_increasing_id())
    step = placed.withColumn("before", F.lag("lies").over(w.orderBy("src", "dst", "lies")))
    facts = step.groupBy("part").agg(F.count("*").alias("edges"), F.bit_xor("dst").alias("xor_dst"), F.count_if(F.col("before") > F.col("lies")).alias("inversions"))
    ends = index.groupBy("part").agg(F.max("end").cast("long").alias("last_end"))
    return facts.join(ends, "part").select("part", "edges", "xor_dst", "last_end", F.col("inversions").cast("int").alias("inversions"))


@query(f"WITH {E} SELECT src AS v, count(*) AS degree FROM e GROUP BY src")
def out_degree(spark, sf_dir):
    return graph.out_degree(_edges(spark, sf_dir)[0])


@query(f"WITH {E} SELECT dst AS v, count(*) AS degree FROM e GROUP BY dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(_edges(spark, sf_dir)[0])


ISO = "iso AS (SELECT v FROM vert WHERE v NOT IN (SELECT src FROM e UNION SELECT dst FROM e))"


@query(f"WITH {E}{VERT}, {ISO} SELECT v FROM iso")
def isolated_vertices(spark, sf_dir):
    return graph.isolated(*_graph(spark, sf_dir))


@query(f"WITH {E} SELECT v.n AS vertices, (SELECT count(*) FROM e) AS edges FROM v")
def graph_totals(spark, sf_dir):
    return graph.totals(*_graph(spark, sf_dir))


PUSH = f"WITH {E} SELECT dst AS v, round(sum(src * 0.5), 6) AS value FROM e WHERE src % 3 = 0 GROUP BY dst"


def _frontier(vertices):
    return vertices.where("v % 3 = 0").withColumn("x", F.col("v") * 0.5)


@query(PUSH)
def push_superstep_sum(spark, sf_dir):
    vertices, edges = _graph(spark, sf_dir)
    return graph.push(_frontier(vertices), edges, F.col("x").cast("double"), F.sum).select("v", r6("value"))


@query(PUSH)
def pull_superstep_sum(spark, sf_dir):
    vertices, edges = _graph(spark, sf_dir)
    return graph.pull(_frontier(vertices), edges, F.col("x").cast("double"), F.sum).select("v", r6("value"))


def _pagerank_sql(iterations: int) -> str:
    out = f"WITH {E}{VERT}, deg AS (SELECT src, count(*) AS d FROM e GROUP BY src), r0 AS (SELECT v, 0.85::DOUBLE AS rank FROM vert)"
    for i in range(1, iterations + 1):
        out += (
            f", g{i} AS (SELECT e.dst AS v, sum(0.15::DOUBLE * r.rank / deg.d) AS x FROM e JOIN r{i - 1} r ON r.v = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst)"
            f", r{i} AS (SELECT vert.v, 0.85::DOUBLE + coalesce(g.x, 0) AS rank FROM vert LEFT JOIN g{i} g ON g.v = vert.v)"
        )
    return out


@query(_pagerank_sql(3) + " SELECT v, round(rank, 6) AS rank FROM r3")
def pagerank_k3(spark, sf_dir):
    return pagerank.ranks(*_graph(spark, sf_dir), 3).select("v", r6("rank"))


@query(_pagerank_sql(3) + " SELECT v, round(rank, 6) AS rank FROM r3")
def pagerank_pull_k3(spark, sf_dir):
    return pagerank.ranks(*_graph(spark, sf_dir), 3, pull=True).select("v", r6("rank"))


@query(
    _pagerank_sql(3) + f", {ISO}, n AS (SELECT count(*) AS iso FROM iso), s AS (SELECT 1 AS iteration, sum(rank) AS t FROM r1 UNION ALL SELECT 2, sum(rank) FROM r2 UNION ALL SELECT 3, sum(rank) FROM r3) "
    "SELECT iteration, round(t, 6) AS total, round(t - iso * 0.85::DOUBLE, 6) AS connected FROM s, n"
)
def pagerank_sums(spark, sf_dir):
    return pagerank.sums(*_graph(spark, sf_dir), 3).select("iteration", r6("total"), r6("connected"))


# Pairs (vertex, level) up to a depth beyond the fixture's; the least level of a vertex is its own.
BFS_LEVELS = "WITH RECURSIVE " + E + ", walk(v, level) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, w.level + 1 FROM walk w JOIN e ON e.src = w.v WHERE w.level < 24), lev AS (SELECT v, min(level) AS level FROM walk GROUP BY v)"


def _bfs(spark, sf_dir, again=False):
    return bfs.search(_edges(spark, sf_dir)[0], 1, again)


@query(BFS_LEVELS + " SELECT v, level FROM lev")
def bfs_levels(spark, sf_dir):
    return _bfs(spark, sf_dir).select("v", "level")


@query(BFS_LEVELS + " SELECT a.v, coalesce(min(e.src), -1) AS parent FROM lev a LEFT JOIN (SELECT e.src, e.dst, b.level FROM e JOIN lev b ON b.v = e.src) e ON e.dst = a.v AND e.level = a.level - 1 GROUP BY a.v")
def bfs_parents(spark, sf_dir):
    return _bfs(spark, sf_dir).select("v", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))


@query(BFS_LEVELS + " SELECT level, count(*) AS n FROM lev GROUP BY level")
def bfs_level_sizes(spark, sf_dir):
    return bfs.level_sizes(_bfs(spark, sf_dir))


@query(BFS_LEVELS + " SELECT count(*) + max(CASE WHEN EXISTS (SELECT 1 FROM e JOIN lev b ON b.v = e.src WHERE e.dst = 1) THEN 1 ELSE 0 END) AS visited FROM lev")
def bfs_visited_reference(spark, sf_dir):
    return _bfs(spark, sf_dir, True).agg(F.count("*").alias("visited"))


# Iterative learning -------------------------------------------------------------------


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))


POINTS = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings)"
DIST = "list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def _kmeans_sql(iterations: int) -> str:
    out = f"WITH {POINTS}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x FROM p ORDER BY id LIMIT {K})"
    for i in range(iterations + 1):
        out += (
            f", d{i} AS (SELECT p.id, c.cid, {DIST} AS d FROM p, c{i} c), "
            f"a{i} AS (SELECT id, cid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r FROM d{i}) WHERE r = 1)"
        )
        if i < iterations:
            out += (
                f", u{i} AS (SELECT cid, pos, avg(v) AS m FROM (SELECT a.cid, unnest(p.x) AS v, unnest(range(len(p.x))) AS pos FROM a{i} a JOIN p ON p.id = a.id) GROUP BY cid, pos), "
                f"c{i + 1} AS (SELECT c.cid, coalesce(list(u.m ORDER BY u.pos) FILTER (u.m IS NOT NULL), list_transform(range({DIM}), lambda z: 0::DOUBLE)) AS x FROM c{i} c LEFT JOIN u{i} u ON u.cid = c.cid GROUP BY c.cid)"
            )
    return out


@query(_kmeans_sql(0) + " SELECT id, cid AS cluster, round(d, 6) AS distance FROM a0")
def kmeans_assign(spark, sf_dir):
    p = _points(spark, sf_dir)
    return kmeans.assign(p, kmeans.first_centres(p, K)).select("id", F.col("cluster").cast("long").alias("cluster"), r6("distance"))


@query(_kmeans_sql(2) + " SELECT cid AS cluster, pos, round(v, 6) AS v FROM (SELECT cid, unnest(range(len(x))) AS pos, unnest(x) AS v FROM c2)")
def kmeans_centers_k2(spark, sf_dir):
    centres, _ = kmeans.train(_points(spark, sf_dir), K, 2)
    rows = [(i, j, float(v)) for i, c in enumerate(centres) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster long, pos long, v double").select("cluster", "pos", r6("v"))


@query(_kmeans_sql(2) + f" SELECT round(sum({DIST}), 6) AS cost FROM p JOIN a1 a ON a.id = p.id JOIN c2 c ON c.cid = a.cid")
def kmeans_cost(spark, sf_dir):
    p = _points(spark, sf_dir)
    return kmeans.cost(p, *kmeans.train(p, K, 2)).select(r6("cost"))


def _logreg_sql(iterations: int) -> str:
    out = f"WITH {POINTS}, f AS (SELECT id, y, unnest(x) AS v, unnest(range(len(x))) AS pos FROM p), w0 AS (SELECT unnest(range({DIM})) AS pos, 0::DOUBLE AS w)"
    for i in range(iterations):
        out += (
            f", s{i} AS (SELECT f.id, any_value(f.y) AS y, 1 / (1 + exp(-sum(f.v * w.w))) AS q FROM f JOIN w{i} w ON w.pos = f.pos GROUP BY f.id)"
            f", w{i + 1} AS (SELECT w.pos, any_value(w.w) - {logreg.RATE} * sum((s.q - s.y) * f.v) AS w FROM f JOIN s{i} s ON s.id = f.id JOIN w{i} w ON w.pos = f.pos GROUP BY w.pos)"
        )
    return out + f", o AS (SELECT f.id, any_value(f.y) AS y, 1 / (1 + exp(-sum(f.v * w.w))) AS q FROM f JOIN w{iterations} w ON w.pos = f.pos GROUP BY f.id)"


@query(_logreg_sql(2) + " SELECT pos, round(w, 6) AS w FROM w2")
def logreg_weights_k2(spark, sf_dir):
    w = logreg.train(_points(spark, sf_dir), DIM, 2)
    return spark.createDataFrame(list(enumerate(w)), "pos long, w double").select("pos", r6("w"))


@query(_logreg_sql(2) + " SELECT id, round(q, 6) AS p, CASE WHEN q >= 0.5 THEN 1 ELSE 0 END AS pred FROM o")
def logreg_predict(spark, sf_dir):
    p = _points(spark, sf_dir)
    return logreg.predict(p, logreg.train(p, DIM, 2)).select("id", r6("p"), "pred")


@query(_logreg_sql(2) + " SELECT round(avg(CASE WHEN (q >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM o")
def logreg_accuracy(spark, sf_dir):
    p = _points(spark, sf_dir)
    return logreg.accuracy(logreg.predict(p, logreg.train(p, DIM, 2))).select(r6("accuracy"))


# Sources and sinks --------------------------------------------------------------------

# The product modulo 2**64 is taken in two 32-bit halves, which fit DuckDB's 128 bits.
NEXT = (
    f"((((({generators.MULTIPLIER >> 32}::HUGEINT * s) % 4294967296) * 4294967296) + {generators.MULTIPLIER & 0xFFFFFFFF}::HUGEINT * s) + {generators.INCREMENT}::HUGEINT) % 18446744073709551616::HUGEINT"
)


@query(
    f"WITH RECURSIVE g(instance, i, s) AS (SELECT k, -1, {generators.INCREMENT}::HUGEINT + k FROM range(3) t(k) UNION ALL SELECT instance, i + 1, {NEXT} FROM g WHERE i < 499) "
    "SELECT instance, i::BIGINT AS i, round(10 * ((s % 4294967296)::DOUBLE / 4294967295), 6) AS v FROM g WHERE i >= 0"
)
def lcg_doubles(spark, sf_dir):
    return generators.lcg_doubles(spark, 3, 500, 0.0, 10.0).select("instance", "i", r6("v"))


WORD_LIST = "[" + ", ".join(f"'{w}'" for w in generators.DICTIONARY) + "]"


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(p_name), '\\s+')) AS word FROM part) WHERE word <> '' GROUP BY word")
def dictionary_load(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_name").alias("value"))
    return generators.dictionary(lines).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT k AS id, {WORD_LIST}[CAST(((((k + 1) * 2654435761 + 7 * 40503) % 4294967296) >> 8) % {len(generators.DICTIONARY)} AS INTEGER) + 1] AS word FROM range(1000) t(k)")
def random_words(spark, sf_dir):
    return spark.range(1000).select("id", generators.random_word(F.col("id"), 7).alias("word"))


RECORD = (("src", "uint32"), ("dst", "uint32"))


@query(f"WITH {E} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def binary_records_roundtrip(spark, sf_dir):
    packed = files.pack_records(_edges(spark, sf_dir)[0], RECORD)
    return packed.select(*files.record_fields(F.col("record"), RECORD)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def binary_file_scan(spark, sf_dir):
    """Edges written as binary files and scanned in equal runs of records."""
    path = jobs.work_folder(spark, "records")
    files.write_binary_records(_edges(spark, sf_dir)[0], path, RECORD)
    return files.read_binary_records(spark, f"{path}/part-*", RECORD, pad=len(files.PAD)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT rpad(hex(value)[1:64], 64, '0') AS line, count(*) AS n FROM lines GROUP BY 1")
def fixed_width_lines(spark, sf_dir):
    lines = wordcount.lines(table(spark, sf_dir, "documents"))
    return lines.select(F.hex(files.fixed_width(F.col("value"), 32)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT replace(text, chr(10), ' ') AS value, count(*) AS n FROM conversations GROUP BY 1")
def text_sink_roundtrip(spark, sf_dir):
    path = jobs.work_folder(spark, "text")
    files.write_text(table(spark, sf_dir, "conversations").select(F.translate("text", "\n", " ").alias("value")), path)
    return files.read_text(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT part, count(*) AS n, bit_xor(checksum) AS checksum FROM (SELECT l_partkey % 4 AS part, CAST(l_orderkey + (l_partkey << 32) AS BIGINT) AS checksum FROM lineitem) GROUP BY part")
def array_persist_append(spark, sf_dir):
    path = jobs.work_folder(spark, "array")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4).alias("part"), (F.col("l_orderkey") + F.shiftleft("l_partkey", 32)).alias("checksum"))
    files.persist_array(rows.where("part < 2"), path)
    files.persist_array(rows.where("part >= 2"), path, append=True)
    return files.load_array(spark, path).groupBy("part").agg(F.count("*").alias("n"), F.bit_xor("checksum").alias("checksum"))


@query("SELECT 'total_num_edges' AS key, (SELECT count(*) FROM lineitem)::VARCHAR AS value UNION ALL SELECT 'total_num_nodes', (SELECT count(*) FROM part)::VARCHAR")
def config_scan(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").agg(F.concat(F.lit("total_num_nodes = "), F.count("*")).alias("value"))
    edges = table(spark, sf_dir, "lineitem").agg(F.concat(F.lit("total_num_edges = "), F.count("*")).alias("value"))
    return files.config_rows(nodes.unionAll(edges))


@query("SELECT 'total_num_edges' AS key, (SELECT count(*) FROM lineitem)::VARCHAR AS value UNION ALL SELECT 'total_num_nodes', (SELECT count(*) FROM part)::VARCHAR")
def config_file_scan(spark, sf_dir):
    path = jobs.work_folder(spark, "config")
    counts = [(f"total_num_{name} = {table(spark, sf_dir, t).count()}",) for name, t in (("nodes", "part"), ("edges", "lineitem"))]
    files.write_text(spark.createDataFrame(counts, "value string"), path)
    return spark.createDataFrame(sorted(files.read_config(spark, path).items()), "key string, value string")


@query("SELECT l_partkey % 4 AS part, count(*) AS n FROM lineitem GROUP BY 1")
def array_in_memory(spark, sf_dir):
    path = jobs.work_folder(spark, "memory")
    files.persist_array(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4).alias("part")), path)
    return files.load_in_memory(spark, path).groupBy("part").agg(F.count("*").alias("n"))


def _squares(instance):
    return ((instance, i, i * i + instance) for i in range(1000))


@query("SELECT k AS instance, i, i * i + k AS v FROM range(4) a(k), range(1000) b(i)")
def generator_function(spark, sf_dir):
    return generators.generate(spark, _squares, "instance long, i long, v long", 4)


# Streams and user-defined functions ----------------------------------------------------


@query(TOP)
def stream_wordcount_topk(spark, sf_dir):
    return jobs.word_top_k(spark, f"{sf_dir}/documents.parquet", 10)


@query(f"WITH {WORDS} SELECT word, count(*) AS n FROM words GROUP BY word")
def watched_text_wordcount(spark, sf_dir):
    """Lines written as text files into a folder that a stream watches, a few files a batch."""
    path = jobs.work_folder(spark, "watched")
    files.write_text(wordcount.lines(table(spark, sf_dir, "documents")).repartition(6), path)
    return jobs.watched_words(spark, path, 2)


@query(f"WITH {EVENTS} SELECT wnid, round(sum(value), 6) AS total, count(*) AS n FROM e GROUP BY wnid")
def stream_latency_trigger(spark, sf_dir):
    return jobs.window_sums(spark, f"{sf_dir}/events.parquet", HOUR_US, every="200 milliseconds").select("wnid", r6("total"), "n")


@query(f"WITH {EVENTS} SELECT wnid, count(*) AS n, 1 AS tasks FROM e GROUP BY wnid")
def shuffle_by_window(spark, sf_dir):
    """All rows of a window meet in one task."""
    events = PCollection(table(spark, sf_dir, "events")).apply(FixedWindows.assign("ts", HOUR_US)).apply(Shuffle.by_window(PARTS))
    return events.df.withColumn("task", F.spark_partition_id()).groupBy("wnid").agg(F.count("*").alias("n"), F.countDistinct("task").cast("int").alias("tasks"))


@query(f"WITH {EVENTS} SELECT wnid, round(sum(value), 6) AS total, count(*) AS n FROM e GROUP BY wnid")
def stream_window_sum(spark, sf_dir):
    return jobs.window_sums(spark, f"{sf_dir}/events.parquet", HOUR_US).select("wnid", r6("total"), "n")


@query(LATE)
def stateful_slots(spark, sf_dir):
    events = jobs.stream_of(spark, f"{sf_dir}/events.parquet", 1_000_000)
    events = events.withColumn("wnid", windows.fixed_window(windows.micros(F.col("ts")), HOUR_US))
    arrivals = events.select("wnid", "value", (F.col("event_id") + (F.col("event_id") * 7919) % 101).alias("arrival"), F.col("event_id").alias("tie"))
    return jobs.stateful_window_sums(spark, arrivals).select("wnid", r6("total"), "n")


@query(f"WITH {EVENTS} SELECT wnid, event_type, round(sum(value), 6) AS total, count(*) AS n FROM e GROUP BY wnid, event_type")
def windowed_combine_per_key(spark, sf_dir):
    events = PCollection(table(spark, sf_dir, "events")).apply(FixedWindows.assign("ts", HOUR_US))
    out = events.apply(WindowedCombine.per_key("event_type", F.sum("value").alias("total"), F.count("*").alias("n")))
    return out.df.select("wnid", "event_type", r6("total"), "n")


class _SplitRole(DoFn):
    schema = "conv_id long, word string"

    def process(self, row):
        for w in (row["text"] or "").split(" "):
            if w:
                yield row["conv_id"], w


@query("SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY 1, 2")
def udtf_pardo(spark, sf_dir):
    words = PCollection(table(spark, sf_dir, "conversations").select("conv_id", "text")).apply(ParDo.of(_SplitRole()))
    return words.df.groupBy("conv_id", "word").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT wnid, round(sum(value), 6) AS total, count(*) AS n FROM e GROUP BY wnid")
def udaf_combine(spark, sf_dir):
    events = PCollection(table(spark, sf_dir, "events").select("ts", "value")).apply(FixedWindows.assign("ts", HOUR_US))
    out = events.apply(WindowedCombine.with_fn(combine.SumCount(), "value", "total double, n long"))
    return out.df.select("wnid", r6("total"), "n")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 25")
def map_pandas(spark, sf_dir):
    def twice(b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["l_quantity"] > 25]
        return b.assign(twice=b["l_quantity"] * 2)[["l_orderkey", "l_linenumber", "twice"]]

    return arrays.par_do(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), twice, "l_orderkey long, l_linenumber int, twice double")


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda t: t * t))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    x = F.transform("x", lambda v: v.cast("double"))
    return _points(spark, sf_dir).select("id", F.round(F.sqrt(vectors.dot(x, x)), 6).alias("norm"))
