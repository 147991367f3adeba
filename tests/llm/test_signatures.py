"""Words, rolling hashes and SuperMinHash against scalar versions."""

import random
import re

import numpy as np
import pyarrow as pa

from consonance.llm import superminhash as S
from consonance.llm import wordkit as W

TEXTS = ["", None, "a b  c\td\ne", " x ", "é ü" + "q" * 600 + " z", "one two three four five six", "A b\x0bC\x0cd\r\ne",
         "abcdefgh abcdefghi abcdefghijklmnopq", " nbsp stays", "same same same same same same"]


def _slice(texts):
    ((_, _, part, ends),) = W.text_slices(pa.array(texts))
    return part, ends


def test_words_and_hashes():
    part, ends = _slice(TEXTS)
    w = W.split_words(part, ends)
    got = [[w.buf[s:e].tobytes().decode() for s, e, d in zip(w.start, w.end, w.doc) if d == i] for i in range(len(TEXTS))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    for seed in (0, 1):
        by = {}
        for s, e, h in zip(w.start, w.end, W.word_hashes(w, seed)):
            assert by.setdefault(w.buf[s:e].tobytes(), int(h)) == int(h)
        assert len(set(by.values())) == len(by)


def test_slices_cover_all_rows_in_order():
    col = pa.array([str(i) * (i % 7) for i in range(500)]).slice(3, 400)
    seen = []
    for a, b, part, ends in W.text_slices(col, 20):
        assert ends[-1] == len(part)
        seen += [part[s:e].tobytes().decode() for s, e in zip(ends, ends[1:])]
    assert seen == col.to_pylist()
    assert list(W.text_slices(pa.array([], pa.string()))) == []


def test_rolling_is_a_polynomial():
    h = np.random.default_rng(0).integers(0, 2 ** 63, 40).astype(np.uint64)
    for which in (0, 1):
        base = int(W.BASES[which])
        for k in (1, 2, 3, 5, 8, 13):
            want = []
            for i in range(len(h) - k + 1):
                v = 0
                for j in range(k):
                    v = (v * base + int(h[i + j])) % 2 ** 64
                want.append(v)
            assert (W.rolling(h, k, which) == W.mix(np.array(want, np.uint64) + np.uint64(k))).all()


def test_shingle_sets():
    part, ends = _slice(TEXTS)
    h, d = W.word_shingle_sets(part, ends, 5)
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        n = len({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}) if w else 0
        assert (d == i).sum() == n


def _scalar(hashes, m):
    out = [None] * m
    for h in hashes:
        p = list(range(m))
        for j in range(m):
            k, v = S._draw(np.array([h], np.uint64), j, m)
            p[j], p[int(k[0])] = p[int(k[0])], p[j]
            if out[p[j]] is None or int(v[0]) < out[p[j]]:
                out[p[j]] = int(v[0])
    return out


def test_superminhash_equals_scalar_version():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (1, 3, 0, 20, 300)]
    sig = S.signatures(np.concatenate(sets), np.repeat(np.arange(5), [len(s) for s in sets]), 5, 32)
    for row, s in zip(sig, sets):
        if len(s):
            assert [int(x) for x in row] == _scalar(s, 32)


def test_estimate_is_unbiased_with_lower_variance():
    rng = np.random.default_rng(2)
    est = []
    for _ in range(150):
        a = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        b = np.concatenate([a[:150], rng.integers(0, 2 ** 63, 50).astype(np.uint64)])
        sig = S.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 250)
        est.append((sig[0] == sig[1]).mean())
    j = 150 / 250
    assert abs(np.mean(est) - j) < 0.01
    assert np.std(est) < (j * (1 - j) / 250) ** 0.5     # plain MinHash


def test_equal_bands_only_for_equal_rows():
    random.seed(0)
    sig = np.random.default_rng(3).integers(0, 3, (50, 6)).astype(np.uint64)
    keys = S.band_keys(sig, 3)
    for b in range(3):
        for x in range(50):
            for y in range(50):
                assert (keys[x, b] == keys[y, b]) == (sig[x, 2 * b:2 * b + 2] == sig[y, 2 * b:2 * b + 2]).all()
