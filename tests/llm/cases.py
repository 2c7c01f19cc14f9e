"""Documents with the awkward cases that every operator must take."""

from pyspark.sql import types as T

CLASHING = (
    "node", "keep", "spans", "score", "ids", "media", "pos", "rid", "label", "n_lines", "n_dropped", "__d", "__pos", "n_bytes", "kept", "lang_pred",
    "quality_score", "n_shingles", "component_id", "__text", "__key", "doc", "row", "gone", "parts", "left", "leaf", "anchor", "context", "check",
)
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators make themselves
        *[T.StructField(n, T.StringType()) for n in CLASHING],
    ]
)
PROSE = "The quick brown fox jumps over the lazy dog, and then it rests under an old tree near the river. "


def rows():
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "one two", PROSE, PROSE, PROSE * 8, PROSE * 8 + "end", long_text, "\u00e9\u00df \U0001f600 \u6f22\u5b57", "a" * 5000, "+1 (988) 555-2485 x@y.org 10.0.0.1", "7" * 40_000, "x" * 60_000]
    out = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in enumerate(texts)]
    out.append((5, PROSE, "en", "s", len(PROSE), *["y"] * len(CLASHING)))  # a repeated id and text
    out.append((None, PROSE * 8, None, None, None, *[None] * len(CLASHING)))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
