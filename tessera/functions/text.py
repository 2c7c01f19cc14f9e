"""Text expressions: splitting, number parsing and result formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number where the last one ended, white space before it allowed.
NUMBER = r"\G\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def split_words(text: Column) -> Column:
    """Words between single spaces; runs of spaces collapse, case and tabs stay."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def parse_doubles(text: Column) -> Column:
    """The numbers a line begins with, up to the first token that is none (a numeric prefix of it counts)."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda n: n.cast("double"))


def format_timestamped(ts: Column, value: Column) -> Column:
    return F.concat(F.lit("ts = "), ts.cast("string"), F.lit("  e = "), F.format_string("%.6f", value))


def format_window(wnid: Column, total: Column, count: Column) -> Column:
    """A window's sum, count and average as text; six decimals."""
    return F.concat(
        F.lit("wnid: "), wnid.cast("string"), F.lit("   sum: "), F.format_string("%.6f", total), F.lit("  count: "), count.cast("string"),
        F.lit("   average: "), F.format_string("%.6f", total / count),
    )


def format_word_map(wnid: Column, entries: Column) -> Column:
    """A window's word counts as text; entries: array of (word, n), listed by word."""
    return F.concat(F.lit("id = "), wnid.cast("string"), F.lit("\n"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("  "), e["word"], F.lit(": "), e["n"].cast("string"), F.lit("\n"))), ""))
