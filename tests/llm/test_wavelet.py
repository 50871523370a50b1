"""The wavelet matrix against the plain sequence, and files through Spark."""

import numpy as np
import pytest

from kinfold.llm import tokens, wavelet


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_matrix_answers_like_the_sequence(n):
    rng = np.random.default_rng(n)
    seq = np.minimum(rng.geometric(0.05, n) * 37, 50256).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(seq, 16)
    assert (m.decode() == seq).all()
    for i in rng.integers(0, max(n, 1), min(n, 60)):
        assert m.access(int(i)) == seq[i]
    for token in [0, 37, 74, 50256, 65535, 1 << 20]:
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(token, a, b) == (seq[a:b] == token).sum()
        at = np.flatnonzero(seq == token)
        assert m.count(token) == len(at)
        if len(at):
            k = int(rng.integers(len(at)))
            assert [m.occurrence(token, j) for j in (0, k, len(at) - 1)] == [at[0], at[k], at[-1]]
        with pytest.raises(IndexError):
            m.occurrence(token, len(at))


def test_wide_ids():
    seq = np.array([0, 70000, 1 << 19, 70000], np.uint32)
    m = wavelet.WaveletMatrix.build(seq, 20)
    assert m.decode().tolist() == seq.tolist()
    assert m.occurrence(70000, 1) == 3


def test_files_round_trip(spark, awkward, clashing, tmp_path):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/ids"
    got, _ = wavelet.encode(clashing(awkward), path, folder, shard_tokens=500)
    got = [tuple(r) for r in got.collect()]
    enc = tokens.PartEncoder(path, True).tokenizer
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 0])
        want.append((r.doc_id, start, len(ids), tokens.crc32(ids)))
        start += len(ids)
    assert sorted(got, key=lambda t: t[1]) == want
    files = sorted((tmp_path / "ids").glob("*.wm"))
    assert len(files) > 3
    assert not list((tmp_path / "ids").glob("*.tmp"))
    shard = wavelet.Shard.from_bytes(files[0].read_bytes())
    assert shard.matrix.count(0) >= len(shard.ids)


def test_empty_table(none):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert wavelet.encode(none, path)[0].count() == 0
