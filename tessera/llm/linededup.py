"""Line dedup with a log-template tree, in DataFrame functions only.

A line's tokens are its parts between spaces, tokens with a digit masked as a
variable field.  The tree has a fixed depth: token count, then the leading tokens.
In a leaf, a token is a constant of its place if lines of at least `min_docs`
documents have it there (a document counts once for each distinct masked line);
other tokens are variable fields too.  The line with its variable fields masked is
its template.  A template of at least `min_docs` documents, constant in at least
`constant_share` of its tokens, recurs: all its lines but the first (by document
id, then place) are dropped.  A template holds its leaf's leading tokens, so it never spans two leaves.

Defined results: a null text has no lines and stays null; lines under `min_tokens`
tokens stay; text without dropped lines stays as it is; rows with equal ids count
as one document, null ids too, which comes first; of such rows each loses only
lines of its own text, and equal rows the same lines; an empty table gives an
empty one; a line or text of any length is taken whole; of equal lines in a
document all but the first go; columns of the result that exist already are
replaced, other columns may have any names.  Only line keys and the lines of
leaves with several documents move through aggregates, which combine before the
shuffle; no leaf is gathered.  Lines are told apart by 128 bits of hash in a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import small
from tessera.session import ensure_checkpoint_dir

MIN_DOCS, MIN_TOKENS, LEADING, CONSTANT_SHARE = 3, 5, 3, 0.6
FIELD = "<*>"
KIND = ("leaf", "kind", "twin")


def masked(line: Column) -> Column:
    """The line with tokens that hold a digit masked."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(line)


def occurrences(text: Column, letter: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))


def lines(docs: DataFrame, key: str, text: str, min_tokens: int, leading: int) -> DataFrame:
    """doc, row (a hash of the text), pos, leaf and line, not yet masked, of each line with enough tokens."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    rows = rows.select("doc", "row", "pos", F.trim("line").alias("line")).withColumn("n", occurrences(F.col("line"), " ") + 1).where(F.col("n") >= min_tokens)
    # masking moves no token, so the leading tokens alone tell the leaf
    return rows.select("doc", "row", "pos", F.xxhash64("n", masked(F.substring_index("line", " ", leading))).alias("leaf"), "line")


def recurring(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, leading: int = LEADING, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """doc, row and pos of each line to drop, with its leaf and the hash of its template."""
    every = lines(docs, key, text, min_tokens, leading)
    leaves = every.groupBy("leaf").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.count("doc").alias("known"), F.count("*").alias("c"))
    several = (F.col("d0") != F.col("d1")) | F.col("known").between(F.lit(1), F.col("c") - 1)
    leaves = leaves.where(several & (F.col("c") >= min_docs)).select("leaf")
    some = every.join(small(leaves), "leaf").withColumn("line", masked(F.col("line")))
    some = some.withColumns({"kind": F.xxhash64("line"), "twin": F.xxhash64(F.lit(1), "line")}).checkpoint()
    # distinct masked lines, each with its number of documents; their tokens move without the line
    kinds = some.select(*KIND, "doc").distinct().groupBy(*KIND).agg(F.count("*").alias("docs"))
    texts = some.groupBy(*KIND).agg(F.min("line").alias("line"))
    parts = kinds.join(texts, [*KIND]).select(*KIND, "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    constant = parts.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("s")).where((F.col("s") >= min_docs) & (F.col("token") != FIELD)).select("leaf", "at", "token", F.lit(1).alias("constant"))
    made = parts.join(constant, ["leaf", "at", "token"], "left").groupBy(*KIND).agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("constant") == 1, F.col("token")).otherwise(F.lit(FIELD)).alias("t")))).alias("ts"),
        F.count("constant").alias("constants"),
        F.count("*").alias("n"),
    )
    made = made.where(F.col("constants") >= constant_share * F.col("n")).select(*KIND, F.xxhash64(F.array_join(F.col("ts.t"), " ")).alias("template"))
    placed = some.select(*KIND, "doc", "row", "pos").join(small(made, 64), [*KIND]).select("leaf", "template", "doc", "row", "pos")
    seen = placed.groupBy("leaf", "template").agg(F.min(F.struct("doc", "row", "pos")).alias("first"))
    wide = placed.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    often = small(seen.join(wide, ["leaf", "template"]).select("leaf", "template", "first"), 64)
    return placed.join(often, ["leaf", "template"]).where(~F.struct("doc", "row", "pos").eqNullSafe(F.col("first"))).select("doc", "row", "pos", "leaf", "template")


def drop_recurring(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """The documents with recurring lines dropped from the text, and n_lines and n_dropped."""
    ensure_checkpoint_dir(docs.sparkSession)
    drops = recurring(docs, text, key, **limits).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    drops = small(drops, F.size("gone").cast("long") * 4 + 48)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*kept).alias("r"), F.col(text).alias("text"), F.col(key).alias("id"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("row")) & F.col("text").isNotNull(), "left")
    joined = joined.select("r", "text", "gone", F.when(F.col("gone").isNotNull(), F.split("text", "\n")).alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    made = joined.select("r", "text", "gone", "parts", F.when(F.col("gone").isNotNull(), left).alias("left"))
    short = F.array_join(F.transform("left", lambda i: F.get("parts", i)), "\n")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(occurrences(F.col("text"), "\n") + 1).cast("long").alias("n_lines")
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("parts") - F.size("left")).cast("long").alias("n_dropped")
    text_now = F.when(F.col("gone").isNull(), F.col("text")).otherwise(short).alias(text)
    return made.select(*(text_now if c == text else F.col("r").getField(c).alias(c) for c in kept), n_lines, n_dropped)


#: The query's rows in DuckDB SQL.
ORACLE_SQL = """
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, trim(unnest(parts), ' ') AS line FROM raw
), tokens AS (
  SELECT doc_id, pos, list_transform(string_split(line, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM lines
), placed AS (
  SELECT doc_id, pos, len(t) AS n, list_slice(t, 1, 3) AS lead, t FROM tokens WHERE len(t) >= 5
), kinds AS (
  SELECT n, lead, t, count(DISTINCT doc_id) AS docs FROM placed GROUP BY ALL
), parts AS (
  SELECT n, lead, t, docs, unnest(range(len(t))) AS i, unnest(t) AS token FROM kinds
), constant AS (
  SELECT n, lead, i, token FROM parts WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 3
), made AS (
  SELECT p.n, p.lead, p.t, string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.i) AS template, count(c.token) AS constants
  FROM parts p LEFT JOIN constant c ON p.n = c.n AND p.lead = c.lead AND p.i = c.i AND p.token = c.token GROUP BY p.n, p.lead, p.t
), templated AS (
  SELECT doc_id, pos, template FROM placed JOIN made USING (n, lead, t) WHERE constants >= 0.6 * n
), often AS (
  SELECT template FROM templated GROUP BY template HAVING count(DISTINCT doc_id) >= 3
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) AS r FROM templated JOIN often USING (template)
), gone AS (
  SELECT doc_id, pos FROM ranked WHERE r > 1
), kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(*) AS n_lines, count(g.pos) AS n_dropped
  FROM (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM raw) l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
