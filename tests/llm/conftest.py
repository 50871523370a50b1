import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, one very long text, one hot source."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(6000)
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(None, text(30)), row(5, "one two"), row(5, "one two"),
        row(6, long), row(7, long), row(8, "é ñ ß " * 20, None), row(9, text(50)),
    ]
    shared = text(120)
    rows += [row(100 + i, shared + " " + text(3), "hot") for i in range(20)]
    rows += [row(200 + i, text(60), f"h{i % 3}") for i in range(20)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture
def clashing():
    """Adds columns whose names an operator may want for itself."""

    def add(df):
        from pyspark.sql import functions as F

        for c in ("measures", "kept", "base_failed", "n", "size", "shard", "slot", "g", "start", "length", "item",
                  "n_words", "n_hit", "n_entities", "cls", "row", "__row", "__mentions", "news", "piece", "__rejected", "rejected_host"):
            df = df.withColumn(c, F.lit("mine"))
        return df

    return add
