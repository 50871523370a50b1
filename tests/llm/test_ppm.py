"""Prediction by partial matching and the word baseline against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import kernels as K
from kinfold.llm import ppm

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def coded(t, order):
    return b"\n" * order + "".join(w + " " for w in tokens(t)).encode() + b"\n"


def brute(train, text, order):
    follow = defaultdict(Counter)
    for t in train:
        b = coded(t, order)
        for i in range(order, len(b)):
            for j in range(order + 1):
                follow[b[i - j : i]][b[i]] += 1
    out, b = 0.0, coded(text, order)
    for i in range(order, len(b)):
        gone, done = set(), False
        for j in range(order, -1, -1):
            left = {s: c for s, c in follow.get(b[i - j : i], {}).items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if b[i] in left:
                out += math.log10(left[b[i]] / whole)
                done = True
                break
            if left:
                out += math.log10(len(left) / whole)
                gone |= set(left)
        if not done:
            out -= math.log10(256 - len(gone))
    return out


def corpus(n=60):
    rng = random.Random(2)
    pool = ["the", "Then", "other", "é", "aa", "aab", "x", "mothers", "ther", "ß9"]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(pool, k=rng.randrange(0, 25)))) for i in range(n)]
    return rows + [(500, None), (501, "zzz QQQ never"), (502, " \t "), (503, "the the")]


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_scores_like_brute_force(spark, order):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in ppm.score(df, order=order, common_words=4).collect()}
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        ws = [*tokens(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(w in c for w in ws), n
        )
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, brute(learn, t, order), rel_tol=1e-9), t


def test_probabilities_of_a_context_add_up_to_one(tmp_path):
    texts = [t for _, t in corpus()]
    levels = []
    for j in range(4):
        g, _ = ppm.grams(*ppm.canonical(K.Words(pa.array(texts), lower=True), 3), 3)
        levels.append(np.unique(g & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True))
    model = ppm.Model([(k, c.astype(np.int64)) for k, c in levels])
    for context in (b"the", b"er ", b"qqq", b"xth", b"\n\n\n", b"\xc3\xa9 "):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert math.isclose((10 ** model.code(keys)).sum(), 1, rel_tol=1e-9)


def test_pruned_trie_keeps_suffixes(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = [r.score for r in ppm.score(df, order=3, max_nodes=30).collect()]
    assert all(-10_000 < s < 0 for s in got)


@pytest.mark.parametrize("order, max_nodes", [(0, 0), (2, 5), (3, 30), (5, 0), (5, 40)])
def test_strings_no_worker_holds_score_alike(spark, monkeypatch, order, max_nodes):
    """Whatever the workers hold, the scores are those of the whole counts."""
    monkeypatch.setattr(ppm, "_TASK_STRINGS", 50, raising=False)
    rows = corpus() + [(None, "mothers thex éé QQ other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in ppm.score(df, order=order, max_nodes=max_nodes).collect()}
    learn = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    for i, t in rows:
        assert math.isclose(got[i].score, brute(learn, t, order), rel_tol=1e-9), t


def test_without_learning_texts_all_bytes_are_alike(spark):
    df = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert math.isclose(ppm.score(df).first().score, -11 * math.log10(256), rel_tol=1e-9)


def test_likes_text_of_the_kind_it_learned(spark):
    rng = random.Random(9)
    stems = ["walk", "talk", "play", "jump", "look", "cook"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["ing", "ed", "er"]) for _ in range(40))) for i in range(200)]
    other = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows += [(i, " ".join(w[::-1] for w in rows[i % 200][1].split())) for i in other]
    held = [r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    kind, strange = ([r.score / r.n_tokens for r in held if (r.doc_id >= 1000) == x] for x in (False, True))
    assert min(kind) > max(strange)


def test_edges(awkward, none, clashing):
    got = ppm.score(clashing(awkward)).collect()
    assert len(got) == awkward.count()
    assert all(r.held_out for r in got if r.doc_id is None)
    assert ppm.score(none).count() == 0
