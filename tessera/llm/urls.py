"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

Everything per row is a DataFrame expression.  Features are binned to a fixed
number of values, so labelled URLs of any number reduce, by one aggregate, to a
bounded number of cells (`MAX_CELLS`); the trees are fitted on those cells and
come back as nested CASE expressions.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and is judged by the trees; repeated rows are judged alike; of two
fitting rules of equal length the one with the longer host wins; without any
labelled URL of both classes every unruled URL gets the class that was seen
(allow where none was); URLs of any length are judged whole; an empty table gives an
empty result; columns named host, path, rule, verdict or block_score are replaced,
others are kept whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import boost

#: So many rules become expressions; more are joined by the suffixes of hosts.
EXPRESSION_RULES = 100
#: Folds by hash of the URL: a training row's suffix rate is that of the other folds.
FOLDS = 5
#: Bins of each feature; their product bounds what training brings to the driver.
BINS = {"length": 8, "depth": 4, "digits": 5, "entropy": 6, "params": 3, "suffix_rate": 5, "suffix_share": 3}
MAX_CELLS = math.prod(BINS.values())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    known = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.when(known, F.translate(raw, UPPER, LOWER)).otherwise(F.lit("")), "path": F.when(known, path).otherwise(F.lit(""))})


def _cut(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(host, path prefix, rule, verdict) of each rule, the weakest first."""
    ranked = sorted(rules, key=lambda r: (len(r[1]), r[1].index("/")))
    return [(text[: text.index("/")], text[text.index("/") :], text, said) for said, text in ranked]


def rule_columns(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of host and path columns; rules are (verdict, host/path-prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, text, said in _cut(rules):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def ruled(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule and __said, its verdict, to rows with host and path; any number of rules."""
    if len(rules) <= EXPRESSION_RULES:
        rule, said = rule_columns(rules)
        return df.withColumns({"rule": rule, "__said": said})
    known = [(i, *r) for i, r in enumerate(_cut(rules))]
    table = df.sparkSession.createDataFrame(known, "__rank long, __host string, __path string, rule string, __said string")
    labels = max(host.count(".") + 1 for _, host, *_ in known)
    pairs = df.select("host", "path").where("host <> ''").distinct()
    own = F.size(F.split("host", r"\."))
    ends = F.transform(F.sequence(F.lit(1), F.least(own, F.lit(labels))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    near = pairs.select("host", "path", F.explode(ends).alias("__host")).join(table, "__host").where(F.startswith("path", F.col("__path")))
    best = near.groupBy("host", "path").agg(F.max_by(F.struct("rule", "__said"), "__rank").alias("__best"))
    return df.join(best, ["host", "path"], "left").withColumns({"rule": F.col("__best.rule"), "__said": F.col("__best.__said")}).drop("__best")


def _binned(x: Column, cuts: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [(x > c).cast("int") for c in cuts])


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds binned lexical features f_* and the host's suffix (its last two labels)."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    letters = F.split(F.lower(u), "")
    entropy = F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda acc, c: acc - ((n - F.length(F.replace(F.lower(u), c, F.lit("")))) / n) * F.log2(F.greatest((n - F.length(F.replace(F.lower(u), c, F.lit("")))) / n, F.lit(1e-9))),
    )
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "f_length": _binned(F.length(u), (32, 36, 40, 44, 48, 56, 72)),
            "f_depth": _binned(F.length(F.col("path")) - F.length(F.translate(F.col("path"), "/", "")), (1, 2, 3)),
            "f_digits": _binned(F.length(F.regexp_replace(u, "[^0-9]", "")) / n, (0.02, 0.08, 0.12, 0.2)),
            "f_entropy": _binned(F.when(F.length(u) > 0, entropy).otherwise(F.lit(0.0)), (3.0, 3.5, 3.8, 4.1, 4.4)),
            "f_params": _binned(F.when(query == "", F.lit(0)).otherwise(1 + F.length(query) - F.length(F.translate(query, "&", ""))), (0, 1)),
            "suffix": F.substring_index(F.col("host"), ".", -2),
        }
    )


def _suffix_features(pos: Column, n: Column) -> list[Column]:
    """Binned smoothed share of blocked URLs and binned frequency."""
    return [_binned((pos + F.lit(1.0)) / (n + F.lit(2.0)), (0.1, 0.3, 0.6, 0.9)).alias("f_suffix_rate"), _binned(n, (10, 1000)).alias("f_suffix_share")]


def suffix_table(labelled: DataFrame) -> DataFrame:
    """Each suffix's features, from all labelled URLs."""
    return labelled.groupBy("suffix").agg(*_suffix_features(F.sum("label"), F.count("*")))


FEATURES = [f"f_{k}" for k in BINS]


def with_suffix(df: DataFrame, suffixes: DataFrame, on: Sequence[str] = ("suffix",)) -> DataFrame:
    return df.join(suffixes, [*on], "left").fillna({"f_suffix_rate": 2, "f_suffix_share": 0})


def fit(labelled: DataFrame, url: str = "url", trees: int = 16, depth: int = 3) -> boost.Boosted:
    """Trees for rows with lexical features, suffix, url and label (1: block).

    A row's suffix features come from the URLs of the other folds, never from its own label.
    """
    dealt = labelled.withColumn("__fold", F.pmod(F.xxhash64(url), F.lit(FOLDS)))
    parts = dealt.groupBy("suffix", "__fold").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    whole = parts.groupBy("suffix").agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    others = parts.join(whole, "suffix").where("all_n > n").select("suffix", "__fold", *_suffix_features(F.col("all_pos") - F.col("pos"), F.col("all_n") - F.col("n")))
    cells = with_suffix(dealt, others, ("suffix", "__fold")).groupBy(*FEATURES).agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()
    x = np.array([[r[f] for f in FEATURES] for r in cells], dtype=np.int64).reshape(-1, len(FEATURES))
    pos, n = (np.array([r[k] for r in cells], dtype=float) for k in ("pos", "n"))
    if not len(cells) or not pos.sum():
        return boost.Boosted(-10.0)
    return boost.fit(x, pos, n - pos, trees, depth)


def _tree(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold, left, right = node
    return F.when(F.col(FEATURES[feature]) <= threshold, _tree(left)).otherwise(_tree(right))


def score(model: boost.Boosted) -> Column:
    raw = reduce(lambda a, b: a + b, [_tree(t) for t in model.trees], F.lit(model.base))
    return 1 / (1 + F.exp(-raw))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict and block_score.

    `labelled` has columns url and label (1: block).  Without it the URLs that a
    rule judges are the labelled ones.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    rows = ruled(lexical(parts(pages.select(F.struct(*kept).alias("__row"), F.col(url).alias("__u")), "__u"), "__u"), rules)
    if labelled is None:
        known = rows.where("__said is not null").withColumn("label", (F.col("__said") == "block").cast("int"))
    else:
        known = lexical(parts(labelled.select(F.col("url").alias("__u"), "label").where("label is not null"), "__u"), "__u")
    suffixes = suffix_table(known)
    model = fit(known, "__u")
    p = score(model)
    judged = with_suffix(rows, suffixes).withColumn("block_score", p)
    verdict = F.coalesce(F.col("__said"), F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*(F.col("__row").getField(c).alias(c) for c in kept), "host", "path", "rule", verdict.alias("verdict"), "block_score")


def held_out_accuracy(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> float | None:
    """Share of rule-judged URLs of the first fold that trees fitted on the other folds judge as the rule does."""
    rows = ruled(parts(pages.select(F.col(url).alias("url")).where(F.col(url).isNotNull())), rules).where("__said is not null")
    rows = rows.select("url", (F.col("__said") == "block").cast("int").alias("label"), (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("held"))
    judged = judge(rows.where("held"), (), labelled=rows.where("not held"))
    return judged.agg(F.avg(((F.col("verdict") == "block").cast("int") == F.col("label")).cast("double"))).first()[0]
