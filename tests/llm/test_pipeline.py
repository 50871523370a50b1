"""The whole pipeline against a brute-force version on a small table, and each stage's own input."""

import random
import re

import pytest
from .test_native import brute as hits
from .test_quality_jaccard import brute as groups
from .test_quality_jaccard import measure

import corpus_pipeline
from kinfold.llm import ngram_jaccard, surrogates, tokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    pool = [f"p{i}" for i in range(80)]
    rows, i = [], 0
    bench = [(b, " ".join(rng.choices(pool, k=20))) for b in range(4)]
    for _ in range(40):
        ws = rng.choices(pool, k=rng.randrange(5, 150))
        for copy in range(rng.choice([1, 1, 3])):
            mine = list(ws)
            if copy == 2:
                mine[len(mine) // 2] = "edit"
            if i % 5 == 0:
                mine[3:3] = [f"me{i % 15}@corp.example.com", "42.144.35.254"]
            if i % 9 == 0:
                mine[2:2] = bench[i % 4][1].split()[2:14]
            rows.append((i, " ".join(mine), "en", f"h{i % 4}", len(" ".join(mine))))
            i += 1
    rows += [(900, None, None, None, None), (901, "", "en", "h1", 0), (902, "same words " * 30, "en", "h2", 330)]
    rows.append(rows[4])
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, bench


def test_run_like_brute_force(spark, folder):
    d, rows, bench = folder
    good = []
    for r in rows:
        n, _, _, _, repeats = measure(r[1])
        if n >= 10 and 100 * repeats <= 20 * n:
            good.append(r)
    first = {}
    for i, _, c in groups([r[:2] for r in good]):
        first[c] = min(first.get(c, i), i)
    good = list({r[0]: r for r in good if r[0] in first.values()}.values())
    clean = {h[0] for h in hits([r[:2] for r in good], bench) if not h[2]}
    good = [r for r in good if r[0] in clean]
    df = spark.createDataFrame([r[:2] for r in good], "doc_id long, text string")
    enc = tokens.PartEncoder(tokens.tokenizer_path("word_bpe_49k.json"), False).tokenizer
    # Surrogates depend on the entities of the table alone, so those of this table are the right ones.
    texts = {r.doc_id: r.text for r in surrogates.replace_entities(df)[0].collect()}
    want = sorted((i, 0, 0, len(enc.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts.items())
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    total = sum(w[3] for w in want)
    assert len({r.sequence_id for r in got}) == -(-total // 4096)


def test_stages_keep_the_columns(spark, folder):
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.schema.simpleString() == docs.schema.simpleString()
    out = corpus_pipeline.personal_data(spark, docs, d).collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    assert not any(re.search(r"@corp|42\.144\.35\.254", r.text or "") for r in out)


def test_one_row_of_a_repeated_row_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (3, ""), (3, ""), (None, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in ngram_jaccard.drop_near_copies(df).collect()), key=str)
    assert got == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)
