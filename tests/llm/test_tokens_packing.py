"""Part-wise encoding against whole texts; packing against its definition."""

import numpy as np
import pytest

from kinfold.llm import packing, tokens

ODD = ["a  b", "a   b ", " a", "  a", "a \nb", "a\n \nb", "a\n bar", "a  b", "x\x1c y", "", " ", "   ", "\n", "\n x",
       "it's  <|endoftext|> x<|startoftext|>y", "\t\t a \t b\n\n  c", "é́ ́a  ñ", "ΑΣ ΑΣ. ΣΑΣ",
       "a b c　 d", "12 345 6,7 'll we'll", "́x y", "H̱. ẖ, E\u0301.", "a.\nB,\n\nc. d.\n",
       "a!! b%%% c.*** d?!' e'!! don't!! 's. é...\nñ;: 5!! x_\u00a0y, \u2028z.", "a.\u00a0 b!\u0085c"]


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_parts_give_the_ids_of_whole_texts(name, leading):
    enc = tokens.PartEncoder(tokens.tokenizer_path(name), leading)
    rng = np.random.default_rng(3)
    pool = list("ab é\n\t '.,!%_1ñ\u00a0") + ["  ", " the", " "]
    texts = ODD + ["".join(rng.choice(pool, 40)) for _ in range(300)]
    want = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        got = enc.encode([*texts, None])
        assert [list(g) for g in got[:-1]] == want
        assert len(got[-1]) == 0


def check_plan(counts, plan, room, documents=None, attention=None):
    length = np.repeat(list(counts), list(counts.values()))
    number = np.concatenate([np.arange(n) for n in counts.values()])
    seq, offset = plan.place(length, number)
    order = np.lexsort((offset, seq))
    s, o, n = seq[order], offset[order], length[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    assert (o[first] == 0).all()
    assert (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all()
    assert np.bincount(seq, length).max() <= room
    if documents:
        assert np.bincount(seq).max() <= documents
    if attention:
        assert np.bincount(seq, length.astype(float) ** 2).max() <= attention
    return len(np.unique(seq))


@pytest.mark.parametrize("rule", packing.RULES)
def test_capacities_hold_and_few_sequences_are_used(rule):
    rng = np.random.default_rng(1)
    for room in (64, 512):
        lengths = np.minimum(rng.geometric(0.02, 3000), room)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.best_fit(counts, room, rule=rule)
        used = check_plan(counts, plan, room)
        assert used <= -(-int(lengths.sum()) // room) * 1.02 + 1
        plan = packing.best_fit(counts, room, documents=4, attention=room * room, weights=(1.0, 1.0, 1.0), rule=rule)
        check_plan(counts, plan, room, 4, room * room)


def test_every_constraint_binds():
    plan = packing.best_fit({10: 100}, 100, documents=3)
    assert check_plan({10: 100}, plan, 100, documents=3) == 34
    plan = packing.best_fit({10: 100}, 100, attention=400)
    assert check_plan({10: 100}, plan, 100, attention=400) == 25
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.best_fit({50: 1}, 100, attention=400)


def test_as_good_as_sequential_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 60, 80)
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            open_ = [b for b in range(len(bins)) if bins[b] >= n]
            if open_:
                bins[min(open_, key=lambda b: bins[b])] -= n
            else:
                bins.append(60 - n)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        assert check_plan(counts, packing.best_fit(counts, 60), 60) == len(bins)


def test_pack_whole_table(spark, awkward, clashing):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    docs = clashing(awkward)
    got = packing.pack(docs, path, tokens=256, keep_ids=True).toPandas()
    enc = tokens.PartEncoder(path, False)
    want = []
    for r in awkward.collect():
        ids = [*enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 256)):
            want.append((r.doc_id, k, s, tuple(ids[s : s + 256])))
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    have = [(None if np.isnan(a) else int(a), b, c, tuple(d)) for a, b, c, d in got[["doc_id", "piece", "start", "ids"]].itertuples(index=False)]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert (got["length"] == got["ids"].map(len)).all()
    assert (got["ids_crc32"] == [tokens.crc32(np.array(i)) for i in got["ids"]]).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 256
        assert (s["offset"].to_numpy() == np.concatenate([[0], np.cumsum(s["length"])[:-1]])).all()


def test_empty_table(none):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0
