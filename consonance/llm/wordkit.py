"""Vectorised words, word hashes and shingle hashes over Arrow batches of texts.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``
(``[^\\x20\\x09-\\x0D]+``); in UTF-8 those separators never occur inside a
longer character, so the split is done on bytes for a whole slice of documents
at once. All functions are pure numpy and hold one slice in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: bytes of text that are worked on at once inside a task
SLICE_BYTES = 1 << 20
#: words longer than this many bytes are hashed one by one
LONG_WORD = 256

U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_GOLD = U(0x9E3779B97F4A7C15)
#: odd multipliers of the two rolling hashes
BASES = (U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * _MIX1
    x = x ^ (x >> U(27))
    x = x * _MIX2
    return x ^ (x >> U(31))


def text_slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most ``max_bytes`` (or one row).

    Null texts have no bytes.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], kind, count=n + 1, offset=col.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lens = np.diff(off)
    if col.null_count:
        lens = np.where(np.asarray(col.is_null()), 0, lens)
    a = 0
    while a < n:
        b = int(np.searchsorted(np.cumsum(lens[a:a + 65536]), max_bytes, "right")) + a
        b = min(max(b, a + 1), n)
        ends = np.concatenate([[0], np.cumsum(lens[a:b])])
        if ends[-1] == off[b] - off[a]:
            part = data[off[a]:off[b]]
        else:
            part = np.concatenate([data[off[i]:off[i] + lens[i]] for i in range(a, b)])
        yield a, b, part, ends
        a = b


#: keeps the first n bytes of a little-endian word
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


@dataclass
class Words:
    """Words of a run of documents: byte ranges in ``buf`` and the document of each."""
    buf: np.ndarray    # bytes, each document followed by one separator, then 8 zero bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray    # row of the slice
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def split_words(part: np.ndarray, ends: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents whose bytes are ``part[ends[i]:ends[i+1]]``; ``lower`` maps A-Z only."""
    n = len(ends) - 1
    buf = np.full(len(part) + n + 8, 0x20, np.uint8)
    if lower:
        part = _LOWER[part]
    first = ends + np.arange(n + 1)  # where each document starts in buf
    for i in range(n):
        buf[first[i]:first[i + 1] - 1] = part[ends[i]:ends[i + 1]]
    word = np.zeros(len(buf) + 1, bool)
    # a byte is a separator if it is 0x20 or 0x09 .. 0x0D (unsigned wrap-around)
    word[1:] = (buf != 0x20) & ((buf - np.uint8(9)) > 4)
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    buf[-8:] = 0
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(start, first)))
    return Words(buf, start, end, doc, n)


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """One 64-bit hash per word, eight bytes at a time over all words together."""
    size = w.end - w.start
    h = mix(size.astype(U) + U((seed + 1) * int(_GOLD) % (1 << 64)))
    if not len(size):
        return h
    eight = np.ndarray((len(w.buf) - 7,), "<u8", w.buf.tobytes(), strides=(1,))
    at = np.arange(len(size))
    first = True
    pos = w.start.copy()
    long = size > LONG_WORD
    if long.any():
        for i in np.flatnonzero(long):
            h[i] = U(xxhash.xxh64_intdigest(w.buf[w.start[i]:w.end[i]].tobytes(), seed=seed))
    while len(at):
        if first:
            left = np.minimum(size, 8)
            x = eight[pos] & _MASK[left]
            np.copyto(h, mix(h ^ x * BASES[seed & 1]), where=~long)
            at, first = np.flatnonzero((size > 8) & ~long), False
        else:
            left = w.end[at] - pos[at]
            x = eight[pos[at]] & _MASK[np.minimum(left, 8)]
            h[at] = mix(h[at] ^ x * BASES[seed & 1])
            at = at[left > 8]
        pos[at] += 8
    return h


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every ``k`` consecutive word hashes (polynomial modulo 2^64, then mixed).

    Built by doubling: the hash of 2m words is the hash of the first m times
    base^m plus that of the next m. Entry i covers words i .. i+k-1; the
    result has len(h) - k + 1 entries.
    """
    if len(h) < k:
        return np.zeros(0, U)
    base = BASES[which]
    out, have = None, 0           # hash of the first `have` words of the window
    block, width, power = h, 1, base
    need = k
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                m = len(h) - have - width + 1
                out = block[:m].copy() if out is None else out[:m] * power + block[have:have + m]
                have += width
            need >>= 1
            if need:
                m = len(block) - width
                block = block[:m] * power + block[width:]
                width, power = width * 2, power * power
    return mix(out[:len(h) - k + 1] + U(k))


def shingles(w: Words, h: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of every window of ``k`` words inside one document."""
    r = rolling(h, k, which)
    inside = w.doc[:len(r)] == w.doc[k - 1:k - 1 + len(r)] if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    return r[at], w.doc[at], at


def distinct_sets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs ordered by document, then hash."""
    if not len(hashes):
        return hashes, doc
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return h[keep], d[keep]


def short_hashes(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the whole word sequence of documents with 1 .. k-1 words."""
    cnt = w.counts()
    first = np.concatenate([[0], np.cumsum(cnt)[:-1]])
    hs, ds = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for n in range(1, k):
        d = np.flatnonzero(cnt == n)
        if len(d):
            v = np.zeros(len(d), U)
            for j in range(n):
                v = v * BASES[0] + h[first[d] + j]
            hs.append(mix(v + U(n)))
            ds.append(d)
    return np.concatenate(hs), np.concatenate(ds)


def word_shingle_sets(part: np.ndarray, ends: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingle hashes per document, A-Z lower-cased, as (hash, document).

    A document with fewer than ``k`` words has its whole sequence as one
    shingle; one without words has none.
    """
    w = split_words(part, ends, lower=True)
    h = word_hashes(w)
    a, d, _ = shingles(w, h, k)
    b, e = short_hashes(w, h, k)
    return distinct_sets(np.concatenate([a, b]), np.concatenate([d, e]))
