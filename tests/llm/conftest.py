import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def make_rows(seed=7, n=120):
    """Documents with nulls, empties, a very long text, copies, near copies, repeated rows and a hot source."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if i % 11 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 13 == 5 and rows and rows[-1][1]:
            text = rows[-1][1] + "\tExtra " + rng.choice(words)
        rows.append((i, text, rng.choice(["en", "de", None]), "src0" if i % 3 else f"src{i % 7}", len(text)))
    rows += [(900, None, "en", None, None), (901, "", None, "src0", 0), (902, " \n\t ", "en", "src1", 4), (903, " ".join(rng.choice(words) for _ in range(20000)), "en", "src2", 0), (904, "one", "en", "src1", 3), (905, "one two", "en", "src1", 7)]
    rows += [rows[4], rows[4], (7, "same id, other text", "fr", "src3", 19), (None, "no id", "en", "src0", 5), (None, "no id", "en", "src0", 5)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns named like internal and output ones."""
    from pyspark.sql import functions as F

    extra = ["fp", "component_id", "n_words", "n_hit", "spans", "items", "size", "shard", "slot", "curve", "start", "tokens", "epoch", "kept", "keep_id", "group_size", "score", "word", "n_tokens"]
    return docs.select("*", *[F.lit("clash").alias(c) for c in extra])
