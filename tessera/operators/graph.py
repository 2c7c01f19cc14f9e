"""Graph operators on edge tables (src, dst): degrees, adjacency, supersteps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids

#: Places whose prefix sums one task takes.
CHUNK = 65_536


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("degree"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without any edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return vertices.join(ends, "v", "left_anti")


def totals(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("vertices")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def push(frontier: DataFrame, edges: DataFrame, message: Column, combine) -> DataFrame:
    """A superstep: each active v (with its values) sends `message` along its out-edges; targets combine.

    frontier: v and values; the result has v and `value`.
    """
    sent = frontier.join(edges, frontier["v"] == edges["src"]).select(F.col("dst"), message.alias("__m"))
    return sent.groupBy(F.col("dst").alias("v")).agg(combine("__m").alias("value"))


def pull(frontier: DataFrame, edges: DataFrame, message: Column, combine) -> DataFrame:
    """The same superstep over reversed edges: each target gathers from its in-neighbours."""
    back = edges.select(F.col("dst").alias("to"), F.col("src").alias("from"), *(c for c in edges.columns if c not in ("src", "dst")))
    got = back.join(frontier, back["from"] == frontier["v"]).select(F.col("to"), message.alias("__m"))
    return got.groupBy(F.col("to").alias("v")).agg(combine("__m").alias("value"))


def running(df: DataFrame, group: str, place: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds `name`, the sum of `value` at the places before, within the group.

    Sums of chunks of places first, then those of the chunks before, then within a
    chunk: no task needs a whole group.
    """
    keyed = df.withColumn("__chunk", ids.whole(F.col(place), chunk))
    sums = keyed.groupBy(group, "__chunk").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__chunk", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group, "__chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(sums, [group, "__chunk"]).withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return placed.drop("__chunk", "__base")


def csr_index(edges: DataFrame, offset_bits: int = ids.OFFSET_BITS) -> DataFrame:
    """Prefix index of a partitioned graph: part, off, begin and end of each vertex's out-edges.

    Edges carry composed ids.  Every partition that owns a source has offsets from 0
    to the largest offset of any endpoint; partitions without rows have none.  The
    largest offset and the partitions' numbers come to the driver.
    """
    part, off = ids.part_of(F.col("src"), offset_bits), ids.offset_of(F.col("src"), offset_bits)
    top = edges.agg(F.max(F.greatest(off, ids.offset_of(F.col("dst"), offset_bits))).alias("top"), F.collect_set(part).alias("parts")).first()
    spark = edges.sparkSession
    if top["top"] is None:
        return spark.createDataFrame([], "part long, off long, begin long, end long")
    every = spark.range(top["top"] + 1).select(F.explode(F.array(*map(F.lit, sorted(top["parts"])))).alias("part"), F.col("id").alias("off"))
    degree = edges.groupBy(part.alias("part"), off.alias("off")).agg(F.count("*").alias("d"))
    full = every.join(degree, ["part", "off"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return running(full, "part", "off", "d", "begin").select("part", "off", "begin", (F.col("begin") + F.col("d")).alias("end"))


def csr_edges(edges: DataFrame, offset_bits: int = ids.OFFSET_BITS) -> DataFrame:
    """Targets in adjacency order: part, pos, dst; edges sorted by (src, dst), duplicates kept.

    A source's edges are numbered from the index's begin, so no window holds more than one source's.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("d")).withColumns({"part": ids.part_of(F.col("src"), offset_bits), "off": ids.offset_of(F.col("src"), offset_bits)})
    begin = running(degree, "part", "off", "d", "begin").select("src", "part", "begin")
    own = Window.partitionBy("src").orderBy("dst")
    placed = edges.select("src", "dst", (F.row_number().over(own) - 1).cast("long").alias("at"))
    return placed.join(begin, "src").select("part", (F.col("begin") + F.col("at")).alias("pos"), "dst")
