"""Compression-distance scores on text whose toxic words are known."""

import random
import zlib

import numpy as np
import pytest

from kinfold.llm import toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    syllables = ["ta", "rin", "mo", "ves", "ul", "pa", "kor", "ni", "sha", "lem"]
    pool = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(500)]
    bad = ["grubnik", "zwoffle", "hyxat", "Blorgh"]
    docs, labels = [], []
    for i in range(n):
        ws = rng.choices(pool, k=rng.randrange(20, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(1, len(ws) // 25)):
                ws[rng.randrange(len(ws))] = rng.choice(bad)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (None, docs[6][1]), (6, docs[6][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    return dict(labels), model, toxicity.score(d, model).collect(), d, lab


def test_held_out_accuracy(scored):
    labels, _, rows, _, _ = scored
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert {r.doc_id for r in held} == {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    y = np.array([labels[r.doc_id] for r in held])
    p = np.array([r.predicted for r in held])
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_edge_rows(scored):
    _, model, rows, d, _ = scored
    assert len(rows) == d.count()
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score < 0.5
    assert by[None].held_out
    six = [r.score for r in rows if r.doc_id == 6]
    assert six[0] == six[1]


def test_held_out_labels_change_nothing(spark, scored):
    labels, model, _, d, _ = scored
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels.items()]
    other = toxicity.fit(d, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert other.toxic == model.toxic and other.plain == model.plain
    assert (other.weights == model.weights).all()


def test_one_class_or_none(spark, awkward, none):
    lab = spark.createDataFrame([(i, 0) for i in range(300)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(awkward, toxicity.fit(awkward, lab)).collect()} == {0.0}
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(awkward, toxicity.fit(awkward, lab)).collect()} == {0.0}
    assert toxicity.score(none, toxicity.fit(none, lab)).count() == 0


def test_few_labels(spark, awkward, clashing):
    lab = spark.createDataFrame([(i, int(i < 105)) for i in range(100, 215)], "doc_id long, toxic int")
    got = toxicity.score(clashing(awkward), toxicity.fit(clashing(awkward), lab)).collect()
    assert len(got) == awkward.count()
