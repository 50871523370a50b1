"""Host rules and the Jaccard join against plain Python."""

import random
import re

import pytest

from kinfold.llm import host_quality, ngram_jaccard
from kinfold.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def measure(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    hit = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)}
    return (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "a b c d e a b c d e", "x\nx\n\nx \n é#\né#", "\n\n", " a\n a\na", "#*$ %&|<>\x0b\x0c ü"]
    texts += [rng.choice([" ", "\n"]).join(rng.choices("ab#é", k=40)) + rng.choice(["", "\n"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = df.withColumn("m", host_quality.measures(df["text"]))
    for r in out.collect():
        assert tuple(r.m) == measure(r.text), r.text


def test_bad_host_falls_with_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "too short", "bad") for i in range(95)] + [(100 + i, f"{good} {i}", "bad") for i in range(5)]
    rows += [(200 + i, f"{good} {i}", "fine") for i in range(95)] + [(300 + i, "x", "fine") for i in range(5)]
    rows += [(400, "x", "tiny"), (401, f"{good} z", "tiny"), (500, f"{good} n", None), (501, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_quality.keep_good(df).collect()}
    assert kept == {*range(200, 295), 401, 500}


def test_quality_keeps_columns(awkward, none, clashing):
    docs = clashing(awkward)
    out = host_quality.keep_good(docs)
    assert out.columns == docs.columns
    assert {r.shard for r in out.collect()} == {"mine"}
    assert host_quality.keep_good(none).count() == 0


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set()))
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(out[find(i)])) for i in range(len(rows)))


def mutated(rng, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return ws


@pytest.mark.parametrize("seed", range(3))
def test_components_of_near_copies(spark, seed):
    rng = random.Random(seed)
    pool = [f"W{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(pool, k=rng.randrange(4, 160))
        for _ in range(rng.randrange(1, 9)):
            rows.append(" ".join(mutated(rng, base, rng.randrange(0, 1 + len(base) // 25 + 1))))
    passage = rng.choices(pool, k=50)
    rows += [" ".join(passage + rng.choices(pool, k=12)) for _ in range(25)]  # shared, mostly not similar
    hub = rng.choices(pool, k=150)
    chain = [hub]
    for _ in range(40):  # neighbours are similar, the ends are not
        chain.append(mutated(rng, chain[-1], 2))
    rows += [" ".join(c) for c in chain]
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_links_where_only_the_full_product_finds_them(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "STAR_ROUNDS", 0)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_KEYS", 0)
    test_components_of_near_copies(spark, 7)


def test_awkward_rows(awkward, none, clashing):
    got = ngram_jaccard.jaccard_components(clashing(awkward)).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 6
    assert by[1].n_shingles == 0 and by[1].component_id == 1
    assert {r.component_id for r in got if r.doc_id and 100 <= r.doc_id < 120} == {100}
    assert sum(r.first for r in got if r.component_id == 5) == 1
    assert ngram_jaccard.jaccard_components(none).count() == 0


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
