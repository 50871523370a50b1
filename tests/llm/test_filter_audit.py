"""The filter audit against plain Python, document by document."""

import itertools
import random
import re

import numpy as np

from kinfold.llm import filter_audit as A

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", *A.FIELDS]


def brute(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    fails = []
    for i, text, _ in docs:
        t = text or ""
        ws = WORD.findall(t)
        fails.append(
            {
                c
                for c, bad in {
                    "A": len(ws) < 200,
                    "B": 100 * len(set(ws)) < 50 * len(ws),
                    "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                    "D": bool(re.search("[#$%&*|]", t)),
                    "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
                }.items()
                if bad
            }
        )
    out = []
    parts = [p or "" for _, _, p in docs]
    for part in set(parts):
        mine = [k for k in range(len(docs)) if parts[k] == part]
        worth = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            alive = set(mine)
            for step, c in enumerate(order, 1):
                gone = {k for k in alive if c in fails[k]}
                failing = {k for k in mine if c in fails[k]}
                alive -= gone
                worth[c] += len(gone)
                ids = [docs[k][0] for k in gone]
                rows.append(
                    [part, "".join(order), step, len(alive), len(gone), len(failing - gone),
                     sum(fails[k] == {c} for k in mine), sum(i in good for i in ids), sum(i in toxic for i in ids)]
                )
        out += [(*r, worth[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = A.audit(d, spark.createDataFrame(labels, LABELS))
    return sorted(tuple(r) for r in out.select(COLUMNS).collect())


def test_audit_equals_plain_counts(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    pool = [None, "", "a", "ABC", "a # b", " \n"]
    for _ in range(25):
        n = rng.choice([3, 199, 200, 201, 400])
        base = " ".join(rng.choice(words[: rng.choice([2, 90, 300])]) for _ in range(n))
        pool.append(base + rng.choice(["", " |", " É" * 9, " ABCDEFGHIJ" * 5, "\x0b\x0cx"]))
    docs = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 180, 2)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_awkward_rows(spark):
    # Ids missing and repeated, one text under one id in two parts, labels given twice.
    docs = [(None, "x", "a"), (None, "x", "a"), (1, "x", "a"), (1, "x", "b"), (1, "x", "a"), (2, "x", "b"), (2, None, None)]
    labels = [(1, 0, 1), (1, 1, 0), (None, 1, 1), (2, 1, None)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_hot_text_and_extra_columns(spark):
    text = " ".join(["the same text"] * 100)
    docs = [(i, text, "en") for i in range(400)] + [(1000 + i, f"{text} {i}", "en") for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for c in ("id", "mask", "h", "n", "good", "part_", "first"):
        from pyspark.sql import functions as F

        d = d.withColumn(c, F.lit("mine"))
    out = A.audit(d, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.removed, r.kept) for r in out] == [(399, 21)]


def test_empty_table(spark):
    assert found(spark, [], []) == []


def test_walk_equals_direct_sums():
    rng = np.random.RandomState(3)
    counts = rng.randint(0, 50, (4, 32, 3))
    states = A.gray_walk(counts)
    for on in range(32):
        alive = [m for m in range(32) if not m & on]
        assert (states[:, on] == counts[:, alive].sum(axis=1)).all()
