"""SuperMinHash signatures (Ertl 2017), vectorised over the documents of a slice.

Each element draws a random permutation of the ``m`` positions one step at a
time: step j puts the value ``j + r_j`` (0 <= r_j < 1) at the j-th position of
its permutation; a document's signature holds, per position, the smallest value
of its elements. Values of step j are all smaller than those of step j + 1, so a document is finished as
soon as all its positions are filled (the early stop of the algorithm): long
documents after step 0, a one-element document after ``m`` steps.
"""

from __future__ import annotations

import numpy as np

from .wordkit import U, _GOLD, mix

_NONE = U(0xFFFFFFFFFFFFFFFF)
#: elements whose partial permutations are held at once (m bytes each)
_HELD = 1 << 16


def _draw(h: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Step j of each element: a place in [j, m) and the signature value (j, 32 random bits)."""
    x = mix(h + U((j + 1) * int(_GOLD) % (1 << 64)))
    place = (((x >> U(32)) * U(m - j)) >> U(32)).astype(np.int64) + j
    return place, (U(j) << U(32)) | (x & U(0xFFFFFFFF))


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) signatures of the sets given by (element hash, document), ``doc`` ascending.

    A document without elements keeps the largest value at all positions.
    """
    if not 1 <= m <= 256:
        raise ValueError("m must be 1 .. 256")
    sig = np.full(n_docs * m, _NONE, U)
    place, value = _draw(h, 0, m)
    np.minimum.at(sig, doc * m + place, value)
    sig = sig.reshape(n_docs, m)
    count = np.bincount(doc, minlength=n_docs)
    todo = np.flatnonzero((sig == _NONE).any(axis=1) & (count > 0))
    first = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(todo):
        held = np.cumsum(count[todo[a:]])
        b = a + max(1, int(np.searchsorted(held, _HELD, "right")))
        _finish(h, place, sig, todo[a:b], first, m)
        a = b
    return sig


def _finish(h: np.ndarray, place0: np.ndarray, sig: np.ndarray, docs: np.ndarray, first: np.ndarray, m: int) -> None:
    """Steps 1, 2, ... for ``docs`` until all their positions are filled."""
    at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
    which = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
    g = h[at]
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(at), 1))
    perm[np.arange(len(at)), place0[at]] = 0
    own = sig[docs]
    rows = np.arange(len(at))
    for j in range(1, m):
        place, value = _draw(g[rows], j, m)
        pos = perm[rows, place].copy()
        perm[rows, place] = perm[rows, j]
        np.minimum.at(own.reshape(-1), which[rows] * m + pos, value)
        open_docs = (own == _NONE).any(axis=1)
        if not open_docs.any():
            break
        rows = rows[open_docs[which[rows]]]
    sig[docs] = own


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(n_docs, bands) 64-bit keys, each from ``m // bands`` neighbouring positions and the band number."""
    n, m = sig.shape
    rows = m // bands
    out = np.empty((n, bands), U)
    for b in range(bands):
        k = mix(np.full(n, b + 1, U))
        for r in range(rows):
            k = mix(k ^ sig[:, b * rows + r])
        out[:, b] = k
    return out
