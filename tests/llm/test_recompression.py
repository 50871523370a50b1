"""Repeated word sequences against brute force; names are the same wherever a stretch stands."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import kernels as K
from kinfold.llm import recompression

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    ws = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, ws, strict=True):
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"v{i}" for i in range(60)] + ["é", "Ñu"]
    text = lambda n: rng.choices(pool, k=n)
    passages = [text(n) for n in (34, 35, 36, 50, 90)]
    rows = []
    for i in range(60):
        ws = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(passages)
        if i % 10 == 0:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = ["run"] * rng.choice([3, 36, 50, 80])
        if i % 11 == 0:
            ws += ["a", "b"] * 30
        if i % 13 == 0:
            ws += ws[-40:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " more"), (7, rows[7][1]), (300, None), (301, "")]
    return rows


@pytest.mark.parametrize(("seed", "window", "few"), [(1, 35, True), (2, 35, False), (3, 12, True), (4, 60, True)])
def test_like_brute_force(spark, monkeypatch, seed, window, few):
    if not few:
        monkeypatch.setattr(recompression, "BROADCAST_ROWS", 0)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in recompression.remove_repeats(df, window=window).collect()]
    assert sorted(got) == sorted(brute(rows, window))


def test_names_inside_equal_stretches_agree():
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(30)]
    for _ in range(40):
        shared = rng.choices(pool, k=35)
        texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 30)) + shared + rng.choices(pool, k=20)) for _ in range(2)]
        inside, kept = [], []
        for t in texts:
            w = K.Words(pa.array([t]))
            at = len(t.split()) - 55
            name, _, low, high = recompression.anchors(w, 35)
            inside.append({int(n) for n, a, b in zip(name, low, high, strict=True) if a <= at <= b})
            kept.append(set(name.tolist()))
        # What a window says of itself is kept wherever the window stands.
        assert inside[0] <= kept[1] and inside[1] <= kept[0]


def test_rounds_shorten():
    w = K.Words(pa.array([" ".join(f"v{i}" for i in np.random.default_rng(0).integers(0, 500, 5000))]))
    s = recompression.Symbols(w)
    before = len(s.name)
    for r in range(3):
        s.pair(r + 1)
    assert len(s.name) < 0.5 * before


def test_edges(awkward, none, clashing):
    rows = recompression.remove_repeats(clashing(awkward)).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].n_removed == by[7].n_removed == 6000 and by[1].n_words == 0
    assert recompression.remove_repeats(none).count() == 0
