import random

import pytest
from pyspark.sql import types as T

#: columns beyond those the operators read; their names clash with names used inside
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EXTRA = T.StructType(DOCS.fields + [T.StructField(n, T.StringType()) for n in ("id", "key", "hash", "size", "start", "sha", "owner", "row", "component", "name", "d", "body", "bytes", "steps")])


def words(n, seed, pool=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with every case: nulls, empty, white space, short, copies, near copies, very long, repeated rows."""
    base, other = words(200, 1), words(120, 2)
    near = list(base)
    near[100] = "changed"
    far = list(base)
    for i in range(0, 200, 12):
        far[i] = f"x{i}"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, "One TWO"), (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(far)), (10, " ".join(base)), (11, " ".join(other)), (11, " ".join(other))]
    rows += [(12, " ".join(words(60_000, 3))), (13, "The " * 900), (14, "éàü ñ 漢字 \U0001f600 İstanbul ΣΑΣ\x85\x1c x"), (None, "no id"), (None, " ".join(base)), (15, "\n".join([" ".join(other[:60]), " ".join(words(30, 4))])), (16, " ".join(words(40, 5) + other[20:95] + words(40, 6)))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if t else None, None if i == 4 else f"s{(i or 0) % 3}", None) for i, t in texts], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def crowded(spark, texts):
    """The same with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 1, *["?"] * 14) for i, t in texts], EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
