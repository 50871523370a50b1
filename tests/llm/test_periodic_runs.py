"""Periodic runs against plain Python that tries every period at every place."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.llm import periodic_runs as P
from kinfold.llm.queries import planted_runs


def smallest_period(ws):
    return next(q for q in range(1, len(ws) + 1) if all(a == b for a, b in zip(ws, ws[q:], strict=False)))


def brute(ws):
    out = []
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i < len(ws) - q:
            j = i
            while j < len(ws) - q and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and smallest_period(ws[i : i + length]) == q:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def words(rng, length, letters):
    ws = []
    while len(ws) < length:
        if rng.random() < 0.4:
            p = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
            ws += (p * rng.randint(1, 9))[: rng.randint(1, 200)]
        else:
            ws += [rng.choice(letters) for _ in range(rng.randint(1, 10))]
    return ws


def test_runs_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "é\x0bé\x0cé\té é é", "a\x1fb " * 9]
    for _ in range(200):
        letters = "abcdefghij"[: rng.choice([1, 2, 3, 5, 10])]
        texts.append(rng.choice([" ", "\n", "  "]).join(words(rng, rng.choice([3, 7, 40, 300]), letters)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out, n, runs, flat = P.runs(docs)
    seen = 0
    for r in out.collect():
        ws = (r.text or "").replace("\x1f", "_").split()
        ws = [w.replace("_", "\x1f") for w in ws]
        want = brute(ws)
        seen += len(want)
        assert r[n] == len(ws)
        assert [tuple(x) for x in r[runs]] == want, r.text
        assert r[flat] == collapsed(ws, want)
    assert seen > 100


def test_extensions_equal_brute_force():
    rng = np.random.RandomState(5)
    for letters, n in ((1, 500), (2, 700), (3, 400), (50, 300)):
        x = np.concatenate([rng.randint(0, letters, n), [letters]])
        x[100:200] = x[0:100]
        ext = P.Extensions(x)
        a = rng.randint(0, n - 1, 400)
        b = a + 1 + rng.randint(0, n, 400) % (n - a)
        got = ext.lce(a, b)
        for i, j, g in zip(a, b, got, strict=True):
            k = 0
            while j + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            assert g == k


def test_long_text_and_ties(spark):
    unit = [f"u{i}" for i in range(700)]
    head = [f"h{i}" for i in range(5000)]
    text = " ".join(head + unit * 30 + ["z"] * 9 + ["x", "y"] * 20 + ["z"] * 9)
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    out, _, runs, _ = P.runs(docs)
    for r in out.collect():
        assert [tuple(x) for x in r[runs]] == [(5000, 21000, 700), (26000, 9, 1), (26009, 40, 2), (26049, 9, 1)]


def test_columns_stay(awkward, none, clashing):
    docs = clashing(awkward)
    out, n, runs, flat = P.runs(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and n == "n_words_"
    rows = out.collect()
    assert len(rows) == docs.count() and {r.n_words for r in rows} == {"mine"}
    assert P.runs(none)[0].count() == 0


def test_planted_text(spark):
    import zlib

    rows = [(i, f"  a{i} b c d\ne f g h i j k l m ") for i in range(200)] + [(None, "a b"), (10**12, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.p) for r in df.withColumn("p", planted_runs(F.col("doc_id"), F.col("text"))).collect()}
    changed = 0
    for i, (text, planted) in got.items():
        ws = (text or "").split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
            changed += 1
        assert (planted or "").split() == ws
    assert changed > 5


def test_pieces_do_not_matter():
    rng = random.Random(2)
    texts = pa.array([" ".join(words(rng, 60, "abc")) for _ in range(40)])
    whole = P._piece(texts)
    parts = [P._piece(texts[i : i + 1]) for i in range(40)]
    for k in range(3):
        assert whole[k].to_pylist() == [x for p in parts for x in p[k].to_pylist()]
