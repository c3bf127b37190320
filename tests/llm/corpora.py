from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents tables from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows, partitions: int = 3):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame([Row(*r) for r in full], DOCUMENTS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def stored(spark):
    """Real documents, small scale."""
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def prose(seed: int, words: int) -> str:
    """Invented sentences; a seed gives the same text each time."""
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "ren", "tu", "vas", "do", "pel", "sin", "or"]
    out = []
    for i in range(words):
        word = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
        out.append(word + (rng.choice([".", ".\n", ","]) if i % 9 == 8 else ""))
    return " ".join(out).replace("\n ", "\n")


#: Null and empty texts and columns, white space, one long word, a long text, ties and repeated rows.
ODD = [
    (None, None, None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "x" * 5000), (5, prose(5, 6000)), (6, prose(6, 80)), (7, prose(6, 80)),
    (8, prose(8, 120), None, "s"), (8, prose(8, 120), None, "s"), (9, "é日本 ́ \U0001F600 ﬁ\x00 <s>", "fr", None), (None, prose(6, 80)),
    (-4, prose(10, 200)), (2**62, prose(10, 200)),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents, spark):
    return spark.createDataFrame([], DOCUMENTS)


def clashing(df):
    """The table with further columns whose names operators may use for themselves."""
    from pyspark.sql import functions as F

    names = ("key", "h", "size", "range", "shard", "rank", "fp", "row", "component", "words", "lines", "line", "n", "first", "score", "ids", "kept", "grp", "mask", "hash")
    return df.select("*", *(F.lit("x").alias(c) for c in names))


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(v is not None, str(v)) for v in r])
