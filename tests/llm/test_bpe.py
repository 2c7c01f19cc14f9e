"""BPE against the tokenizers library, on edge cases, random text and one table."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from tessera.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()
EDGES = ["", " ", "   ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "  \x1c\x85 x  y", "日本語 テスト ①②", "x" * 3000, " " * 500, "don't we'll", "a  b\n\n c \t d", " a  b"]


def ids(b: bytes) -> list[int]:
    return np.frombuffer(b, dtype="<u4").tolist()


def test_matches_the_library():
    rng = random.Random(3)
    parts = ["a", "th", "e ", " ", "\n", "'s", "9", "é", "ß", "\U0001f600", "\x00", "\x1d", "İ", "٣", "  ", "\t", "!!", "<|endoftext|>", "​"]
    texts = EDGES + ["".join(rng.choice(parts + [chr(rng.randrange(32, 0xD7FF))]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    library, mine = tokenizers.Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    for text, got in zip(texts, mine.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(got) == want
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False)
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(9)]
        assert mine.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    docs = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (None, "", "y")], schema)
    out = bpe.decode(bpe.encode(docs, PATH, keep=("doc_id", "ids")), PATH, keep=("doc_id", "n_tokens")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 2, "hello world")] * 2 + [(2, 0, ""), (None, 0, "")], key=str)
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    assert Row(*bpe.encode(docs, PATH).columns) == Row("doc_id", "ids", "n_tokens")
