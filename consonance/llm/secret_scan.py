"""Secret scans: patterns, and a character convolutional network over every candidate and its context.

Base findings (kinds ``assign``, ``access``, ``hex``) are matches of fixed
patterns and always stay. Every other run of eight or more token characters is
a candidate; a small character CNN in numpy reads the candidate with the
characters around it, and candidates whose calibrated probability reaches the
threshold of their shape are added as kind ``learned``. Scoring works on
thousands of candidates at once: their views are one gather over the code
points of a batch of texts, and the convolution over the embedding is a sum of
looked-up rows (one table per pair of neighbouring characters and filter).

Training reads every document: base findings are positive, other candidates
negative. A quarter of the texts, by hash, is kept for
calibration; the examples of all others train the network. The rarer label is a pool whose
examples are dealt out in groups and come up in every step of a task; of the
other label each example comes up once, in rounds: slices of the documents by
hash, each four times as large as the one before. The tasks of a round train
copies of the network on their parts of the slice, and the mean of the copies
starts the next round (after the first, every example is scored, and those with
a margin of ``EASY`` on their side have no loss; the first slice, about ``SLICE`` examples, is one task's
and is gone over ``EPOCHS`` times, since the network starts from random numbers).
Contexts are blanked at random, so the network learns the look of a secret and
not only the word before it. All examples of the calibration part are scored
and counted by label, shape and margin (to 1 / ``FINE``); from the counts the
scores are calibrated (Platt), and each shape (hexadecimal, other) gets the
highest threshold that keeps ``RECALL`` of its labelled findings; a shape with
too few of them takes the common threshold (even odds without any). Only counts and
at most ``SHARDS`` networks of some KB come to the driver. Scanning is one pass over whole texts
with the model broadcast.

Offsets are code points, end exclusive. Defined cases: null or empty texts have
no findings; every row is scanned on its own, whatever its id; without labelled
findings of both kinds nothing is learned and the base findings alone are
returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table, written

NAME = "op6_secret_scan"
#: what ``_first`` keeps
MAX_EXAMPLES = 4000
RECALL = 0.99
#: turns over the first slice
EPOCHS = 14
SEED = 6
#: examples of the first slice, of a part of the next ones at least, and that are mixed together
SLICE = 1 << 14
#: tasks of a round at most, and growth from round to round
SHARDS, GROWTH = 128, 4
#: examples of a step, those of the pool among them at least, and in a group of the pool about
STEP, POOLED, POOL = 256, 32, 4000
RATE = 0.004
#: the margin from which on an example that a network of the rounds before has right adds no loss
EASY = 4.0
#: steps of a margin in the counts of the calibration, and the largest margin that is told apart
FINE, FAR = 64, 32
#: fewer labelled findings of a shape than this take the common threshold
FEW = 30

# fixed values: the base patterns, and the fewest characters of what must be long enough
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
KINDS = ("assign", "access", "hex", "learned")

# same matches as HEX with the length filter: matches of HEX are whole runs
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)
_HEXLIKE = re.compile(r"[0-9a-fA-F]+\Z")
#: how matches of ASSIGN start, in lower case
_STARTS = ("passw", "secret", "token", "api")
#: characters that a candidate has at least
CANDIDATE_MIN = 8
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]")

#: characters before, of (``HEAD + TAIL`` together) and after a span that a view holds
BEFORE, HEAD, TAIL, AFTER = 24, 32, 16, 8
_LEN = BEFORE + HEAD + TAIL + AFTER
#: views that are scored together, about
VIEWS = 20_000
#: characters of the texts whose codes are held together, about
BATCH_CHARS = 1 << 20
_CHARS, _DIM, _WIDTH, _FILTERS = 97, 8, 5, 24


def _assigns(text: str) -> Iterator[re.Match]:
    """The matches of ``ASSIGN.finditer``, tried only where a keyword starts."""
    low = text.lower()
    if len(low) != len(text):  # a character that is longer in lower case
        yield from ASSIGN.finditer(text)
        return
    at = []
    for word in _STARTS:
        k = low.find(word)
        while k >= 0:
            at.append(k)
            k = low.find(word, k + 1)
    end = 0
    for k in sorted(at):
        if k >= end and (m := ASSIGN.match(text, k)):
            end = m.end()
            yield m


def base_findings(text: str, runs: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind), ordered by start, then kind as listed.

    ``runs``, if known: the whole token runs of ``HEX_MIN`` characters or more, outside which no long ``hex`` can lie.
    """
    out = [(m.start(), m.end(), "assign") for m in _assigns(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    for s, e in ((0, len(text)),) if runs is None else runs:
        out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text, s, e)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping spans of what one view holds that cover a run whole, a view's half apart; the last one ends with the run."""
    width = HEAD + TAIL
    if end - start <= width:
        return [(start, end)]
    return [(a, a + width) for a in [*range(start, end - width, width // 2), end - width]]


_CODE = np.array([c - 31 if 32 <= c < 127 else 96 for c in range(128)], np.uint8)
_IS_TOKEN, _IS_HEX = (np.array([32 <= c + 31 < 127 and bool(kind.match(chr(c + 31))) for c in range(_CHARS)])
                      for kind in (_TOKEN, _HEXLIKE))


def _in_views(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the parts of runs, and the run of each."""
    long = np.flatnonzero(end - start > HEAD + TAIL)
    run = np.arange(len(text))
    if not len(long):
        return text, start, end, run
    cut = [parts(s, e) for s, e in zip(start[long].tolist(), end[long].tolist())]
    many = np.ones(len(text), np.int64)
    many[long] = [len(c) for c in cut]
    run = np.repeat(run, many)
    start, end = start[run], end[run]
    spans = np.isin(run, long)
    start[spans], end[spans] = np.array([p for c in cut for p in c]).T
    return text[run], start, end, run


class Codes:
    """Character codes of a batch of texts, with room between them that reads as no character."""

    def __init__(self, texts: list[str]):
        room = max(BEFORE, AFTER)
        gap = "\0" * room
        c = np.frombuffer((gap + "".join([t + gap for t in texts])).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = room + np.cumsum(sizes + room) - sizes - room
        self.codes = _CODE[np.minimum(c, 127)]
        # a text may hold the character of the gap, which reads as any other that is not known
        self.codes[:room] = 0
        self.codes[((self.first + sizes)[:, None] + np.arange(room)).ravel()] = 0

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of the whole token runs of ``CANDIDATE_MIN`` characters or more."""
        token = _IS_TOKEN[self.codes]
        edge = np.flatnonzero(token[1:] != token[:-1]) + 1
        a, b = edge[::2], edge[1::2]
        long = b - a >= CANDIDATE_MIN
        a, b = a[long], b[long]
        text = np.searchsorted(self.first, a, "right") - 1
        return text, a - self.first[text], b - self.first[text]

    def hexlike(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the spans are hexadecimal digits only."""
        other = np.concatenate([[0], np.cumsum(~_IS_HEX[self.codes])])
        return other[self.first[text] + start] == other[self.first[text] + end]

    def views(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Codes around and of spans (of at most ``HEAD + TAIL`` characters) of the texts; 0 where there is none."""
        a, b = (self.first[text] + start).astype(np.int64), (self.first[text] + end).astype(np.int64)
        at = a[:, None] + np.arange(-BEFORE, HEAD + TAIL)
        at = np.where(at < b[:, None], at, 0)  # the room before the first text
        return self.codes[np.concatenate([at, b[:, None] + np.arange(AFTER)], axis=1)]


def view(text: str, start: int, end: int) -> np.ndarray:
    """The view of one span."""
    return Codes([text]).views(np.array([0]), np.array([start]), np.array([end]))[0]


def _clear(base: list[tuple[int, int, str]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether runs touch none of some findings, which are ordered by start."""
    # the furthest end of the findings that start before a run's end
    far = np.concatenate([[0], np.maximum.accumulate([e for _, e, _ in base])])
    return far[np.searchsorted([s for s, _, _ in base], end)] <= start


def findings_and_candidates(texts: list[str], codes: Codes) -> tuple[
        list[list[tuple[int, int, str]]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The base findings of each text, and text, start and end of its candidates.

    Candidates are whole token runs of ``CANDIDATE_MIN`` characters or more that touch no base finding.
    """
    text, start, end = codes.runs()
    long = end - start >= HEX_MIN
    wide: dict[int, list[tuple[int, int]]] = {}
    for k, s, e in zip(text[long].tolist(), start[long].tolist(), end[long].tolist()):
        wide.setdefault(k, []).append((s, e))
    base = [base_findings(t, wide.get(k, ())) for k, t in enumerate(texts)]
    keep = np.ones(len(text), bool)
    for k, own in enumerate(base):
        if own:
            a, b = np.searchsorted(text, [k, k + 1])
            keep[a:b] = _clear(own, start[a:b], end[a:b])
    return base, (text[keep], start[keep], end[keep])


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The candidates of one text beside some base findings."""
    _, start, end = Codes([text]).runs()
    keep = _clear(base, start, end)
    return list(zip(start[keep].tolist(), end[keep].tolist()))


_ZONE = np.zeros((_LEN, 2))
_ZONE[BEFORE:BEFORE + HEAD + TAIL, 0] = 1
_ZONE[BEFORE + HEAD + TAIL:, 1] = 1


@dataclass
class Net:
    """Embedding, one convolution, max-pooling inside and outside the span, a logistic unit."""
    emb: np.ndarray
    conv: np.ndarray
    cb: np.ndarray
    out: np.ndarray
    ob: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict | None = None

    def forward(self, x: np.ndarray):
        e = np.concatenate([self.emb[x], np.broadcast_to(_ZONE.astype(self.emb.dtype), (len(x), *_ZONE.shape))], axis=2)
        win = np.lib.stride_tricks.sliding_window_view(e, _WIDTH, axis=1).reshape(len(x), _LEN - _WIDTH + 1, -1)
        z = np.maximum(win @ self.conv + self.cb, 0)
        inside = slice(BEFORE - 2, BEFORE + HEAD + TAIL - 2)
        zi = z[:, inside]
        zo = np.concatenate([z[:, :BEFORE - 2], z[:, BEFORE + HEAD + TAIL - 2:]], axis=1)
        pool = np.concatenate([zi.max(axis=1), zi.mean(axis=1), zo.max(axis=1)], axis=1)
        return win, z, pool, pool @ self.out + self.ob[0]

    def _tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """What two neighbouring characters (the last one alone) add to each filter, and what the zone of a place adds."""
        conv = self.conv.reshape(_DIM + 2, _WIDTH, _FILTERS)  # (channel, place in the window, filter)
        one = np.einsum("cd,dkf->kcf", self.emb, conv[:_DIM])
        pairs = [(one[k][:, None] + one[k + 1]).reshape(-1, _FILTERS) for k in range(0, _WIDTH - 1, 2)]
        zone = np.lib.stride_tricks.sliding_window_view(_ZONE, _WIDTH, axis=0)
        bias = np.einsum("pdk,dkf->pf", zone, conv[_DIM:]) + self.cb
        return [t.astype(np.float32) for t in (*pairs, one[-1])], bias.astype(np.float32)

    def margins(self, x: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """The margin of ``forward``, by looked-up sums in single precision, a place of many views at a time.

        Views are taken by the length of their span: behind its end all places of a view have one value, added at once.
        """
        (t0, t1, t2), bias = self._tables()
        a, b, width = BEFORE - 2, BEFORE + HEAD + TAIL - 2, HEAD + TAIL
        same = range(BEFORE, BEFORE + width - _WIDTH + 1)  # places whose window lies in the span's zone
        blank = np.maximum(bias[BEFORE] + t0[0] + t1[0] + t2[0], 0)
        weights, out = self.out.astype(np.float32), np.zeros(len(x), np.float32)
        there = x[:, BEFORE + width - 1:BEFORE - 1:-1] != 0
        size = np.where(there.any(axis=1), width - there.argmax(axis=1), 0)
        order = np.argsort(-size, kind="stable")
        z_all, add_all = (np.empty((at_once, _FILTERS), np.float32) for _ in range(2))
        for i in range(0, len(x), at_once):
            mine = order[i:i + at_once]
            m, codes, sizes = len(mine), x[mine].T.astype(np.intp), size[mine]
            two = codes[:-1] * _CHARS + codes[1:]
            top, total, outside = (np.zeros((m, _FILTERS), np.float32) for _ in range(3))
            for p in range(_LEN - _WIDTH + 1):
                k = int(np.searchsorted(-sizes, BEFORE - p)) if p in same else m
                if not k:
                    continue
                z, add = z_all[:k], add_all[:k]
                np.take(t0, two[p, :k], axis=0, out=z, mode="clip")
                z += bias[p]
                np.take(t1, two[p + 2, :k], axis=0, out=add, mode="clip")
                z += add
                np.take(t2, codes[p + 4, :k], axis=0, out=add, mode="clip")
                z += add
                if a <= p < b:
                    np.maximum(z, 0, out=z)
                    total[:k] += z
                    np.maximum(top[:k], z, out=top[:k])
                else:
                    np.maximum(outside, z, out=outside)
            left = np.maximum(len(same) - sizes, 0).astype(np.float32)[:, None]
            total += left * blank
            np.maximum(top, np.where(left > 0, blank, 0), out=top)
            out[mine] = np.concatenate([top, total / np.float32(b - a), outside], axis=1) @ weights
        return out + np.float32(self.ob[0])

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def _new_net(rng: np.random.Generator) -> Net:
    return Net(rng.normal(0, 0.3, (_CHARS, _DIM)), rng.normal(0, 0.15, (_WIDTH * (_DIM + 2), _FILTERS)), np.zeros(_FILTERS),
               rng.normal(0, 0.15, 3 * _FILTERS), np.zeros(1))


def _gradients(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    win, z, pool, m = net.forward(x)
    g = (weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) / len(y)).astype(net.out.dtype)
    d_out, d_pool = pool.T @ g, g[:, None] * net.out
    dz = np.zeros_like(z)
    n, f = np.arange(len(x))[:, None], np.arange(_FILTERS)
    inside = slice(BEFORE - 2, BEFORE + HEAD + TAIL - 2)
    zi = z[:, inside]
    dz[:, inside] += d_pool[:, None, _FILTERS:2 * _FILTERS] / zi.shape[1]
    dz[n, zi.argmax(axis=1) + inside.start, f] += d_pool[:, :_FILTERS]
    places = np.concatenate([np.arange(BEFORE - 2), np.arange(inside.stop, z.shape[1])])
    dz[n, places[z[:, places].argmax(axis=1)], f] += d_pool[:, 2 * _FILTERS:]
    dz *= z > 0
    flat = dz.reshape(-1, _FILTERS)
    d_conv = win.reshape(len(flat), -1).T @ flat
    # (channel, place) as sliding_window_view lays it out; the zone has no parameters
    dwin = (flat @ net.conv[:_DIM * _WIDTH].T).reshape(len(x), dz.shape[1], _DIM, _WIDTH)
    de = np.zeros((len(x), _LEN, _DIM), dz.dtype)
    for k in range(_WIDTH):
        de[:, k:k + dz.shape[1]] += dwin[..., k]
    at = x.ravel()
    d_emb = np.stack([np.bincount(at, de[..., i].ravel(), _CHARS) for i in range(_DIM)], axis=1)
    return [d_emb, d_conv, flat.sum(axis=0), d_out, np.array([g.sum()])]


class Learner:
    """Trains a copy of a network on examples of one label as they come, with a pool of the other label in every step."""

    def __init__(self, net: Net, pool: np.ndarray, label: int, pooled: int, rate: float, seed: Sequence[int],
                 started: bool = False):
        self.params = [p.astype(np.float32) for p in _params(net)]
        self.net, self.rng = Net(*self.params), np.random.default_rng(seed)
        self.pool, self.label, self.pooled, self.rate = pool, label, pooled, rate
        self.m1, self.m2 = ([np.zeros_like(p) for p in self.params] for _ in range(2))
        self.order, self.steps, self.started = np.zeros(0, np.int64), 0, started

    def _from_pool(self, n: int) -> np.ndarray:
        """The next ``n`` of the pool: all of it in a random order, again and again."""
        while len(self.order) < n:
            self.order = np.concatenate([self.order, self.rng.permutation(len(self.pool))])
        pick, self.order = self.order[:n], self.order[n:]
        return self.pool[pick]

    def learn(self, x: np.ndarray, turns: int = 1) -> None:
        """Every example of ``x`` once a turn, in a random order; with a margin of ``EASY`` on its side it has no loss."""
        if self.started:
            m = self.net.margins(x)
            x = x[(m if self.label else -m) < EASY]
        for _ in range(turns):
            mixed = self.rng.permutation(len(x))
            for a in range(0, len(mixed), STEP - self.pooled):
                own = x[mixed[a:a + STEP - self.pooled]]
                other = self._from_pool(self.pooled)
                xb = np.concatenate([own, other])
                y = np.repeat([self.label, 1 - self.label], [len(own), len(other)])
                weight = np.repeat([0.5 * len(xb) / len(own), 0.5 * len(xb) / len(other)], [len(own), len(other)])
                xb[np.ix_(self.rng.random(len(xb)) < 0.4, np.r_[:BEFORE, _LEN - AFTER:_LEN])] = 0
                self.steps += 1
                for p, g, a1, a2 in zip(self.params, _gradients(self.net, xb, y, weight), self.m1, self.m2):
                    a1 += 0.1 * (g - a1)
                    a2 += 0.001 * (g * g - a2)
                    p -= self.rate * (a1 / (1 - 0.9 ** self.steps)) / (np.sqrt(a2 / (1 - 0.999 ** self.steps)) + 1e-8)


def _params(net: Net) -> list[np.ndarray]:
    return [net.emb, net.conv, net.cb, net.out, net.ob]


def _pooled(n_pool: int, n_stream: int) -> int:
    """Examples of the pool in a step: its share, at least ``POOLED``, at most half."""
    return min(max(POOLED, -(-STEP * n_pool // (n_pool + n_stream))), STEP // 2)


def _bins(net: Net, x: np.ndarray) -> np.ndarray:
    """Margins in steps of 1 / ``FINE``, rounded down."""
    return np.floor(np.clip(net.margins(x).astype(np.float64), -FAR, FAR) * FINE).astype(np.int64)


def _calibrated(net: Net, y: np.ndarray, hexlike: np.ndarray, bins: np.ndarray, n: np.ndarray) -> Net:
    """``net`` with slope, shift and thresholds from counts ``n`` of examples by label, shape and margin."""
    margin = bins / FINE
    if len(np.unique(y)) == 2:
        # Platt: a logistic fit of label on margin, by Newton steps with a small ridge; labels count alike, as they do in training
        w = n / np.where(y == 1, n[y == 1].sum(), n[y == 0].sum()) * min(n[y == 1].sum(), n[y == 0].sum())
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            g = np.array([(w * (p - y) * margin).sum() + 1e-2 * (a - 1), (w * (p - y)).sum() + 1e-2 * b])
            s = w * p * (1 - p)
            hess = np.array([[(s * margin * margin).sum() + 1e-2, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, g)
        net.slope, net.shift = float(max(a, 1e-3)), float(b)
    net.thresholds = {}
    for shape in (True, False, None):
        good = (y == 1) & ((hexlike == shape) if shape is not None else True)
        by, many = margin[good], n[good]
        if shape is None or many.sum() >= FEW:
            # the highest threshold that keeps RECALL of the labelled findings; a bin's lower end
            order = np.argsort(by, kind="stable")
            at = np.searchsorted(np.cumsum(many[order]), int((1 - RECALL) * many.sum()), side="right")
            m = net.slope * by[order[at]] + net.shift if len(by) else 0.0
            net.thresholds[shape] = float(1 / (1 + np.exp(-np.clip(m, -30, 30))))
    return net


def fit(x: np.ndarray, y: np.ndarray, hexlike: np.ndarray, epochs: int = EPOCHS) -> Net | None:
    """The network of one slice: trained on three quarters, calibrated on the rest; None without both labels."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    net = _new_net(rng)
    order = rng.permutation(len(y))
    cal = order[::4]
    use = np.setdiff1d(order, cal)
    use = use if len(np.unique(y[use])) == 2 else order
    label = int(2 * y[use].sum() > len(use))
    stream, pool = x[use[y[use] == label]], x[use[y[use] != label]]
    learner = Learner(net, pool, label, _pooled(len(pool), len(stream)), RATE, [SEED])
    learner.learn(stream, epochs)
    return _calibrated(learner.net, y[cal], hexlike[cal], _bins(learner.net, x[cal]), np.ones(len(cal)))


def _examples(texts: list[str | None], label: int | None = None,
              shapes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Views, labels and whether hexadecimal (else False), of the base findings (1) and candidates (0) of the texts, some at a time."""
    for i, j in _parts(texts):
        own = [t or "" for t in texts[i:j]]
        codes = Codes(own)
        base, (text, start, end) = findings_and_candidates(own, codes)
        if label == 1:
            text, start, end = text[:0], start[:0], end[:0]
        runs = [(k, ASSIGN.match(own[k], s).start(2) if kind == "assign" else s, e)
                for k, found in enumerate(base if label != 0 else ()) for s, e, kind in found]
        y = np.repeat([1, 0], [len(runs), len(text)])
        text, start, end = (np.concatenate([r, c]).astype(np.int64) for r, c in zip(zip(*runs) if runs else ((), (), ()), (text, start, end)))
        at = np.argsort(text, kind="stable")  # by text, its findings first
        y, text, start, end = y[at], text[at], start[at], end[at]
        hexlike = codes.hexlike(text, start, end) if shapes else np.zeros(len(y), bool)
        text, start, end, run = _in_views(text, start, end)
        y, hexlike = y[run], hexlike[run]
        a, ends = 0, np.searchsorted(text, np.arange(1, j - i + 1))  # of each text
        while a < len(text):
            b = ends[min(np.searchsorted(ends, a + VIEWS), len(ends) - 1)]
            yield codes.views(text[a:b], start[a:b], end[a:b]), y[a:b], hexlike[a:b]
            a = b


def _of_label(label: int):
    """Views of one label, and a row with the number of runs of either label for every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = np.zeros(2, np.int64)
            texts, backs = rb.column("text").to_pylist(), rb.column("back").to_pylist()
            for i, j in _parts(texts):
                own = [t or "" for t in texts[i:j]]
                base, (of, _, _) = findings_and_candidates(own, Codes(own))
                n += len(of), sum(map(len, base))
                for k in ([k for k, found in enumerate(base) if found] if label else np.unique(of).tolist()):
                    for x, _, _ in _examples([own[k]], label, False):
                        yield pa.RecordBatch.from_pydict({"x": pa.array([v.tobytes() for v in x], pa.binary()), "back": pa.array(
                            [backs[i + k]] * len(x), pa.bool_()), **{f"n{c}": pa.array([0] * len(x), pa.int64()) for c in (0, 1)}})
            yield pa.RecordBatch.from_pydict({"x": pa.array([None], pa.binary()), "back": pa.array([None], pa.bool_()),
                                              **{f"n{k}": pa.array([int(n[k])], pa.int64()) for k in (0, 1)}})
    return run


def _part_learner(net: Net, label: int, pooled: int, rate: float, turn: int):
    """Rows (shard, h, x, text), a shard's pool first: (shard, steps, the trained copy) of every shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pool, held, learner = None, [], [], None

        def learn() -> None:
            nonlocal learner, held
            first = learner is None
            if first:
                learner = Learner(net, np.frombuffer(b"".join(pool), np.uint8).reshape(-1, _LEN), label, pooled, rate, [SEED, turn, now],
                                  turn > 0)
            x, held = np.concatenate(held), []
            learner.learn(x, EPOCHS if first and turn == 0 else 1)

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                learn()
            if learner is not None:
                yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "steps": pa.array([learner.steps], pa.int64()),
                                                  "net": pa.array([pickle.dumps(learner.params)], pa.binary())})

        for rb in batches:
            shards = rb.column("shard").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                if shards[a] != now:
                    yield from done()
                    now, pool, held, learner = int(shards[a]), [], [], None
                own = rb.slice(a, b - a)
                views = [v for v in own.column("x").to_pylist() if v is not None]
                pool += views
                for x, _, _ in _examples(own.column("text").to_pylist()[len(views):], label, False):
                    held.append(x)
                    if sum(map(len, held)) >= SLICE:
                        learn()
        yield from done()
    return run


def _counter(net: Net):
    """Counts of the calibration part by label, shape and margin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 2 * FAR * FINE + 1
        n = np.zeros(4 * wide, np.int64)
        for rb in batches:
            for x, y, h in _examples(rb.column("text").to_pylist()):
                n += np.bincount((2 * y + h) * wide + _bins(net, x) + FAR * FINE, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})
    return run


def _rounds(n: int) -> list[tuple[float, float, int]]:
    """(from, to, shards) of the slices of a hash range from 0 to 1 that holds ``n`` examples."""
    out, at, size = [], 0, SLICE
    while at < n:
        end = n if at + size * (1 + 1 / GROWTH) >= n else at + size
        out.append((at / n, end / n, 1 if not at else min(SHARDS, -(-(end - at) // SLICE))))
        at, size = end, size * GROWTH
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Net | None:
    """Fit on the labelled findings and the other candidates of all rows; None without both."""
    # copies of a text train or calibrate together
    src = _source(docs, id_col, text_col).withColumn("back", F.expr("pmod(xxhash64(text, 1), 4) = 0"))
    parts_of = "x binary, back boolean, n0 long, n1 long"
    seen = written(src.select("text", "back").mapInArrow(_of_label(1), parts_of), "secret-pool")
    n = [x or 0 for x in seen.agg(F.sum("n0"), F.sum("n1")).first()]
    if not all(n):
        return None
    label = int(n[1] > n[0])  # of the stream; the other label is the pool
    if label:
        seen = written(src.select("text", "back").mapInArrow(_of_label(0), parts_of), "secret-pool")
    pool = seen.where("x is not null").select("x", "back")
    held = dict(pool.groupBy("back").count().collect())
    # with few examples all of them train and calibrate
    back = min(held.get(True, 0), held.get(False, 0)) >= POOLED
    pool = pool.where("not back") if back else pool
    n_pool = held[False] if back else sum(held.values())
    learned, counted = (src.where("not back"), src.where("back")) if back else (src, src)
    pooled, net = _pooled(n[1 - label], n[label]), _new_net(np.random.default_rng(SEED))
    rounds = _rounds(n[label])
    groups = min(max(1, n_pool // POOL), max(k for _, _, k in rounds))
    pool = pool.select(F.pmod(F.xxhash64("x"), F.lit(groups)).cast("int").alias("g"), F.lit(None).cast("long").alias("h"), "x",
                       F.lit(None).cast("string").alias("text"))
    # a document's place in the hash range, and its part of the slice, whatever the partitions
    text = learned.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("place", F.expr("shiftrightunsigned(h, 33) / 2147483648D"))
    for turn, (a, b, shards) in enumerate(rounds):
        own = text.where((F.col("place") >= a) & (F.col("place") < b)).select(
            F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", F.lit(None).cast("binary").alias("x"), "text")
        # every shard gets one group of the pool; with fewer shards than groups the later rounds reach the others
        dealt = pool.withColumn("shard", F.explode(F.expr(f"filter(sequence(0, {shards - 1}), i -> pmod(i + {turn}, {groups}) = g)")))
        rows = dealt.select("shard", "h", "x", "text").unionByName(own).repartition(shards, "shard").sortWithinPartitions("shard", "h", "x")
        got = rows.mapInArrow(_part_learner(net, label, pooled, RATE / 2 ** turn, turn), "shard int, steps long, net binary").collect()
        if any(r.steps for r in got):
            got.sort(key=lambda r: r.shard)
            steps = np.array([r.steps for r in got], float)
            net = Net(*[sum(w * p for w, p in zip(steps / steps.sum(), ps)).astype(np.float32)
                        for ps in zip(*(pickle.loads(r.net) for r in got))])
    counts = counted.select("text").mapInArrow(_counter(net), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at")
    at, many = (np.array(x, np.int64) for x in list(zip(*counts.collect())) or ((), ()))
    kind, bins = at // (2 * FAR * FINE + 1), at % (2 * FAR * FINE + 1) - FAR * FINE
    return _calibrated(net, kind // 2, kind % 2 == 1, bins, many)


def _first(ex: DataFrame, n: int) -> DataFrame:
    """The ``MAX_EXAMPLES`` smallest of ``n`` examples by hash (for callers that look at some; ``train`` reads all).

    Hashes are evenly spread, so these lie in the lowest part of their range, and no task merges what many others kept.
    """
    bound = int(2.0 ** 64 * min(1.0, 2 * MAX_EXAMPLES / max(n, 1))) - 2 ** 63
    low = ex.where(F.col("h") < F.lit(bound)) if bound < 2 ** 63 else ex
    if low is not ex and low.count() < min(n, MAX_EXAMPLES):
        low = ex
    return low.orderBy("h", "x").limit(MAX_EXAMPLES)


FINDINGS = "array<struct<kind:string,first:int,last:int,score:double>>"


def _at_least(scores: np.ndarray, least: float) -> tuple[list[int], list[float]]:
    """Places and values of the scores from ``least`` on."""
    at = np.flatnonzero(scores >= least)
    return at.tolist(), scores[at].tolist()


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``BATCH_CHARS`` characters each; a longer text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t or "") > BATCH_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if len(texts) > a:
        yield a, len(texts)


def scan(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text",
         carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, findings (ordered by start, then kind; ``last`` is exclusive; score is null for base findings), and ``carry`` columns.

    ``redacted`` is the text with every finding replaced by ``[secret]``, overlapping ones together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        least = min(net.thresholds.values()) if net is not None else 1.0
        for rb in batches:
            texts = rb.column("text").to_pylist()
            found, clean = [], []
            for i, j in _parts(texts):
                own = [t or "" for t in texts[i:j]]
                codes = Codes(own)
                base, runs = findings_and_candidates(own, codes)
                found += [[{"kind": kind, "first": s, "last": e, "score": None} for s, e, kind in f] for f in base]
                for a in range(0, len(runs[0]) if net is not None else 0, VIEWS):
                    text, start, end = (x[a:a + VIEWS] for x in runs)
                    *spans, run = _in_views(text, start, end)
                    p = net.probability(codes.views(*spans))
                    # a run's score is that of its highest view
                    top = np.maximum.reduceat(p, np.searchsorted(run, np.arange(len(text))))
                    for k, q in zip(*_at_least(top, least)):
                        t, s, e = int(text[k]), int(start[k]), int(end[k])
                        if q >= net.thresholds.get(bool(_HEXLIKE.match(own[t][s:e])), net.thresholds[None]):
                            found[i + t].append({"kind": "learned", "first": s, "last": e, "score": q})
            for i, mine in enumerate(found):
                mine.sort(key=lambda f: (f["first"], KINDS.index(f["kind"])))
                clean.append(_redact(texts[i], mine))
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(c) for c in ("doc_id", *carry)], pa.array(found, kind), pa.array(clean, pa.string())],
                names=["doc_id", *carry, "findings", "redacted"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in carry],
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return src.mapInArrow(run, ", ".join(["doc_id long", *[f"`{c}` {types[c]}" for c in carry],
                                          f"findings {FINDINGS}", "redacted string"]))


def _redact(text: str | None, found: list[dict]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for f in found:
        if f["first"] >= at:
            out += [text[at:f["first"]], "[secret]"]
        at = max(at, f["last"])
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every whole document."""
    docs = table(spark, sf_dir, "documents")
    f = scan(docs, train(docs))

    def joined(keep: str):
        return F.expr(f"array_join(transform({keep}, f -> concat(f.kind, ':', f.first, ':', f.last)), ',')")

    def count(kind: str):
        return F.expr(f"cast(size(filter(findings, f -> f.kind = '{kind}')) as bigint)").alias(f"n_{kind}")

    return f.select("doc_id", count("assign"), count("access"), count("hex"),
                    F.sha2(joined("filter(findings, f -> f.kind <> 'learned')"), 256).alias("base_sha256"),
                    joined("findings").alias("spans"))


SQL = None
