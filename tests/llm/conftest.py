import random

import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("key", T.LongType()), T.StructField("node", T.StringType())])


def rows_of(pairs, sources=("a", "b", None)):
    return [(i, t, "en", sources[k % len(sources)], None if t is None else len(t), "x", 7, None) for k, (i, t) in enumerate(pairs)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names the operators use inside."""
    return lambda pairs, sources=("a", "b", None): spark.createDataFrame(rows_of(pairs, sources), SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """Ordinary, empty, null, repeated, near-equal, very long and odd texts; ids unique but for one row repeated whole."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "ñ", "ou", "é", "st"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, shared = prose(200), prose(90)
    near = base.split()
    near[100] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, prose(120) + "\n" + shared), (5, shared + "\n" + prose(80)), (6, None), (7, ""), (8, " \t\n"), (9, "two words"), (10, "two words"),
           (11, "one\x00two three 漢字 😀 <|endoftext|>"), (12, prose(3000)), (13, "a " * 400), (14, "menu | home | about | news | shop | help " * 12), (None, prose(60)), (15, "x" * 2500)]
    return [*out, out[3]]
