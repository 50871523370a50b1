"""Near copies by bottom-k sketches against all pairs in plain Python."""

import random

import numpy as np
import pyarrow as pa
from kinfold.llm import bottom_k as B
from pyspark.sql import functions as F

from .test_quality_jaccard import brute

KIND = "doc_id long, text string"


def found(spark, rows, **options):
    out = B.near_copies(spark.createDataFrame(rows, KIND), **options)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def mutated(rng, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"n{rng.randrange(10**6)}"
    return ws


def corpus(rng, groups, sizes, shared=0):
    common = [[f"c{p}_{i}" for i in range(40)] for p in range(shared)]
    rows = []
    for _ in range(groups):
        ws = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))]
        for p in rng.sample(common, min(len(common), 2)):
            ws += p
        for _ in range(rng.choice([1, 2, 5])):
            rows.append((len(rows), " ".join(mutated(rng, ws, rng.choice([0, 1, len(ws) // 30, len(ws) // 12])))))
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark):
    rng = random.Random(13)
    rows = corpus(rng, 60, [1, 2, 5, 30, 90, 130, 600], shared=3)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9005, "ONE two"), (9006, "two one")]
    assert found(spark, rows) == sorted(brute(rows, n=2), key=str)


def test_shared_passages_and_hot_group(spark):
    rng = random.Random(14)
    rows = corpus(rng, 30, [3, 20], shared=5)
    one = [f"g{i}" for i in range(150)]
    rows += [(5000 + i, " ".join(mutated(rng, one, 3))) for i in range(150)]
    rows += [(6000 + i, " ".join(one)) for i in range(80)]
    assert found(spark, rows) == sorted(brute(rows, n=2), key=str)


def test_small_sketches_lose_nothing_here(spark):
    # A large group around one text, all pairs of it linked or not, with sketches far below the set size.
    rng = random.Random(15)
    rows = corpus(rng, 25, [300, 900])
    assert found(spark, rows, k=64, least=40) == sorted(brute(rows, n=2), key=str)


def test_union_estimate():
    rng = np.random.RandomState(1)
    x, y, want = [], [], []
    for _ in range(60):
        both = set(rng.randint(0, 10**6, rng.randint(0, 60)).tolist())
        a = both | set(rng.randint(0, 10**6, rng.randint(1, 60)).tolist())
        b = both | set(rng.randint(0, 10**6, rng.randint(1, 60)).tolist())
        sa, sb = sorted(a)[:32], sorted(b)[:32]
        top = sorted(a | b)[:32]
        share = 80 if len(top) < 32 else 40
        want.append(100 * sum(v in a and v in b for v in top) >= share * len(top))
        x.append(sa)
        y.append(sb)
    got = B._estimate(32, 80, 40).func(pa.array(x, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64())))
    assert got.to_pylist() == want


def test_wide_signatures_tell_large_sets_apart():
    rng = np.random.RandomState(2)
    base = rng.randint(0, 2**62, 3000).astype(np.uint64)
    fresh = rng.randint(0, 2**62, 3000).astype(np.uint64)
    # Two linked sets, of signatures of unlike lengths; two unlike ones, which 512 bits leave possible; a small set.
    sets = [base[:2200], base[:2000], fresh[:2200], fresh[2200:2700]]
    values, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    narrow = B._signatures(values, first)
    bits = int(np.bitwise_count(narrow[0] ^ narrow[2]).sum())
    assert 180 * bits <= 20 * (2200 + 2200)
    wide = B._lists(*B._wide(values, first))
    assert [len(w) for w in wide] == [128, 64, 128, 0]
    n = pa.array([len(s) for s in sets])
    got = B._wide_possible(80).func(n.take(pa.array([0, 1, 0])), wide.take(pa.array([0, 1, 0])), n.take(pa.array([1, 0, 2])), wide.take(pa.array([1, 0, 2])))
    assert got.to_pylist() == [True, True, False]


def search(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    found = B._Search(docs, "doc_id", "text", B.N, B.PERCENT, B.SKETCH, B.LEAST_PERCENT)
    return found, found.lists[0].unionByName(found.lists[1])


def test_large_sets_that_share_little_make_no_pair(spark):
    # A tenth in common: 512 bits leave the pair possible, twice as many of the sketch do not.
    shared = [f"s{i}" for i in range(130)]
    one, lists = search(spark, [" ".join(shared + [f"{c}{i}" for i in range(1200)]) for c in "ab"])
    assert lists.count() > 0
    assert one._stars(lists).count() == 0


def test_lists_hold_what_can_meet_there(spark):
    # Sizes too far apart; then one size, of which one class must list the value among its first ninth.
    _, lists = search(spark, [" ".join(f"w{i}" for i in range(n)) for n in (50, 100)])
    assert lists.count() == 0
    _, lists = search(spark, [" ".join([f"{c}{i}" for i in range(90)] + [f"w{i}" for i in range(60)]) for c in "abc"])
    assert lists.groupBy("g").agg(F.min("pos").alias("first")).where("first > 17").count() == 0


def test_sizes_around_those_of_signatures_equal_all_pairs(spark):
    rng = random.Random(18)
    rows = corpus(rng, 14, [330, 380, 400, 470, 520, 640], shared=4)
    assert found(spark, rows) == sorted(brute(rows, n=2), key=str)


def test_large_sets_equal_all_pairs(spark):
    rng = random.Random(16)
    rows = corpus(rng, 8, [700, 1400, 2300])
    assert found(spark, rows) == sorted(brute(rows, n=2), key=str)


def test_repeated_rows_give_one_text(spark):
    rng = random.Random(17)
    ws = [f"w{i}" for i in range(700)]
    rows = [(1, " ".join(ws))] * 3 + [(None, " ".join(mutated(rng, ws, 2)))] * 2 + [(7, " ".join(mutated(rng, ws, 3)))]
    out = B.near_copies(spark.createDataFrame(rows, KIND))
    assert sorted((str(r.doc_id), r.component_id) for r in out.collect()) == [("1", 1)] * 3 + [("7", 1)] + [("None", 1)] * 2


def test_awkward_tables(spark, awkward, none, clashing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    labels = {i: c for i, _, c in brute(numbered, n=2)}
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, []).append(rows[i][0])
    out = B.near_copies(clashing(awkward)).collect()
    assert len(out) == len(rows)
    want = {}
    for members in groups.values():
        ids = [m for m in members if m is not None]
        for m in members:
            want.setdefault(m, set()).add(min(ids) if ids else None)
    for r in out:
        assert r.component_id in want[r.doc_id]
        assert r.kept == (r.component_id == r.doc_id)
    assert B.near_copies(none).count() == 0
