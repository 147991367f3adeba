"""SentencePiece encoding with the original byte span of every piece, and decoding.

How a text is encoded:

1. ``Normaliser`` rewrites the text by the rules stored in the model: at each
   position the longest key of the compiled character map (a double-array trie)
   that is a prefix of the rest is replaced, user-defined symbols are kept as
   they are, white space is trimmed, prefixed and escaped as the model says.
   For every byte of the result it records the byte of the source that it came
   from (``source``; one more entry for the end).
2. The model's own segmentation runs over the normalised text, with the
   normalising rules of the model switched off: what it splits is exactly what
   step 1 wrote.
3. Piece lengths in normalised bytes give begin and end of each piece, and
   ``source`` projects these to byte spans of the original text. Spans ascend;
   the bytes of a character that falls back to byte pieces belong to the last
   of them, an added space has the empty span before the text.

Long texts: no vocabulary entry holds a space symbol after another character
(checked when the model is loaded), so no merge crosses a place where a space
symbol follows another character; normalised texts are cut there into segments
of about ``SEGMENT_CHARS`` characters. Models for which that does not hold are
given whole texts.

The model file (under 1 MB) is read once on the driver and broadcast. Each
document is a row of its own in ``mapInArrow``; nothing is shuffled.

Defined cases: null texts count as empty; an empty text has the end id alone,
with the empty span; every row is encoded on its own, whatever its id (null and
repeated ids included); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, table

NAME = "op12_piece_offsets"
#: characters of a segment of a long normalised text
SEGMENT_CHARS = 1 << 16
#: bytes of text whose rows leave the worker in one batch
BATCH_BYTES = 4 << 20

SPACE = "▁"
_SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)

# Fixed values of the model file format: field numbers of its messages, piece types, model type
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_PIECE_TEXT, _PIECE_TYPE = 1, 3
_MODEL_TYPE, _SPACE_AS_SUFFIX, _BYTE_FALLBACK = 3, 24, 35
_NAME, _CHARMAP, _DUMMY_PREFIX, _TRIM, _ESCAPE = 1, 2, 3, 4, 5
_NORMAL, _USER_DEFINED, _BYTE = 1, 4, 6
_BPE = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message: integers, or the bytes of strings and sub-messages."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i:i + size]
        i += size


def _message(number: int, body: bytes) -> bytes:
    """A sub-message (of under 128 bytes) as a field."""
    return bytes([number << 3 | 2, len(body)]) + body


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, then the replacements, each ended by a zero byte.

    A trie unit holds in bit 8 whether a key ends there, in bits 0 to 7 (and 31)
    its label, and from bit 9 on the distance to its children.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:]

    def _child(self, at: int, byte: int) -> int | None:
        unit = self.units[at]
        to = at ^ (unit >> 10 << ((unit & 512) >> 6)) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def starts(self, char: bytes) -> bool:
        """Whether a key begins with ``char``."""
        at = 0 if self.units else None
        for byte in char:
            if at is None:
                return False
            at = self._child(at, byte)
        return at is not None

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` holds at ``i``, and its replacement."""
        at, best = 0, None
        for j in range(i, len(data)):
            at = self._child(at, data[j])
            if at is None:
                break
            unit = self.units[at]
            if unit & 256:
                leaf = self.units[at ^ (unit >> 10 << ((unit & 512) >> 6))] & 0x7FFFFFFF
                best = j + 1 - i, leaf
        return best and (best[0], self.texts[best[1]:self.texts.index(0, best[1])])


class Normaliser:
    """The normalising rules of a model, with the source byte of every byte written."""

    def __init__(self, spec: bytes = b"", symbols: tuple[bytes, ...] = (), space_as_suffix: bool = False):
        got = dict(fields(spec))
        self.map = CharacterMap(got.get(_CHARMAP, b""))
        self.dummy, self.trim, self.escape = (bool(got.get(k, 1)) for k in (_DUMMY_PREFIX, _TRIM, _ESCAPE))
        self.suffix = space_as_suffix
        self.symbols = sorted(symbols, key=len, reverse=True)
        self.space = _SPACE_BYTES if self.escape else np.frombuffer(b" ", np.uint8)
        self._seen: dict[str, bool] = {}

    def _starters(self, text: str) -> list[bytes]:
        """Characters of ``text`` with which a key or a symbol begins."""
        if not (self.map.units or self.symbols):
            return []
        chars = set(text)
        for c in chars - self._seen.keys():
            e = c.encode()
            self._seen[c] = self.map.starts(e) or any(s.startswith(e) for s in self.symbols)
        return [c.encode() for c in chars if self._seen[c]]

    def _replacements(self, text: str, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(first byte, length, replacement) of every key, left to right, the longest first."""
        starters = self._starters(text)
        if not starters:
            return
        pattern, i = re.compile(b"|".join(map(re.escape, starters))), 0
        while (m := pattern.search(data, i)) is not None:
            i = m.start()
            symbol = next((s for s in self.symbols if data.startswith(s, i)), None)
            hit = (len(symbol), symbol) if symbol else self.map.longest(data, i)
            if hit:
                yield i, *hit
            i += hit[0] if hit else m.end() - i

    def _rewritten(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Bytes after the character map, their source bytes, the first byte of their unit, bytes of the source.

        A unit is what one step wrote: a replacement, or a character left as it is.
        """
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(len(raw))
        heads = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, at, 0)) if len(raw) else at
        out, source, unit, done, size = [], [], [], 0, 0
        for i, n, new in self._replacements(text, data):
            out += [raw[done:i], np.frombuffer(new, np.uint8)]
            source += [heads[done:i], np.full(len(new), i)]
            unit += [heads[done:i] - done + size, np.full(len(new), size + i - done)]
            size, done = size + i - done + len(new), i + n
        if not out:
            return raw, heads, heads, len(raw)
        unit.append(heads[done:] - done + size)
        return np.concatenate([*out, raw[done:]]), np.concatenate([*source, heads[done:]]), np.concatenate(unit), len(raw)

    def _lead(self, text: str) -> int:
        """Source bytes of the leading steps that each wrote one space."""
        data, n = text.encode(), 0
        while n < len(data):
            hit = self.map.longest(data, n) if self.map.units else None
            if hit and hit[1] == b" ":
                n += hit[0]
            elif not hit and data[n] == 0x20:
                n += 1
            else:
                break
        return n

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        out, source, unit, end = self._rewritten(text)
        first = 0
        if self.trim:
            first = self._lead(text)
        if first == end:
            return "", np.array([0])
        space = out == 0x20
        if self.trim:  # spaces at the head of a unit go where a space (or nothing) comes before the unit
            words = np.concatenate([[0], np.cumsum(~space)])
            after = np.concatenate([[True], space])[unit]
            keep = ~(space & (words[1:] == words[unit]) & after)
            out, source, space = out[keep], source[keep], space[keep]
        if self.escape:
            width = np.where(space, len(_SPACE_BYTES), 1)
            begin = np.cumsum(width) - width
            source, out = np.repeat(source, width), np.repeat(out, width)
            for k, byte in enumerate(_SPACE_BYTES):
                out[begin[space] + k] = byte
        if self.dummy and not self.suffix:
            out = np.concatenate([self.space, out])
            source = np.concatenate([np.full(len(self.space), first), source])
        data = out.tobytes()
        if self.trim:
            mark, n = self.space.tobytes(), len(data)
            while data.endswith(mark, 0, n):
                n -= len(mark)
            if n < len(data):
                data, end, source = data[:n], int(source[n]), source[:n]
        if self.dummy and self.suffix:
            data += self.space.tobytes()
            source = np.concatenate([source, np.full(len(self.space), end)])
        return data.decode(), np.append(source, end)


class Pieces:
    """A model: ids of whole texts, with the byte span of each in the text."""

    def __init__(self, model: bytes, segment_chars: int = SEGMENT_CHARS):
        parts = list(fields(model))
        trainer = dict(fields(b"".join(v for k, v in parts if k == _TRAINER)))
        entries = [dict(fields(v)) for k, v in parts if k == _PIECES]
        self.texts = [e[_PIECE_TEXT] for e in entries]
        self.kinds = np.array([e.get(_PIECE_TYPE, _NORMAL) for e in entries])
        symbols = tuple(t for t, k in zip(self.texts, self.kinds) if k == _USER_DEFINED)
        self.normaliser = Normaliser(b"".join(v for k, v in parts if k == _NORMALISER), symbols,
                                     bool(trainer.get(_SPACE_AS_SUFFIX, 0)))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a later copy of a field replaces the earlier one: no map, no added space, no trimming, no escaping
        off = _message(_NAME, b"identity") + _message(_CHARMAP, b"") + bytes(
            [_DUMMY_PREFIX << 3, 0, _TRIM << 3, 0, _ESCAPE << 3, 0])
        self.splitter = sentencepiece.SentencePieceProcessor(model_proto=model + _message(_NORMALISER, off))
        self.sizes = np.where(self.kinds == _BYTE, 1, [len(t) for t in self.texts])
        self.fallback = bool(trainer.get(_BYTE_FALLBACK, 0))
        mark = self.normaliser.space.tobytes().decode()
        self._cut = re.compile(f"(?<=[^{mark}]){mark}")
        apart = trainer.get(_MODEL_TYPE) == _BPE and self.fallback and not any(
            self._cut.search(t.decode()) for t, k in zip(self.texts, self.kinds) if k != _BYTE)
        self.segment_chars = segment_chars if apart else None

    def _segments(self, text: str) -> Iterator[str]:
        a = 0
        while self.segment_chars and len(text) - a > self.segment_chars:
            m = self._cut.search(text, a + self.segment_chars)
            if m is None:
                break
            yield text[a:m.start()]
            a = m.start()
        yield text[a:]

    def _split(self, segment: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised segment and their sizes in bytes of it."""
        ids = np.array(self.splitter.encode(segment), np.int32)
        if self.fallback:
            return ids, self.sizes[ids]
        return ids, np.array([len(p.encode()) for p in self.splitter.encode(segment, out_type=str)], np.int64)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, without an end id. A short text goes to the library as it is."""
        if not self.segment_chars or len(text) <= self.segment_chars:
            return np.array(self.library.encode(text), np.int32)
        return np.concatenate([self._split(s)[0] for s in self._segments(self.normaliser(text)[0])])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a text, without an end id, and the first and behind-last source byte of each."""
        normalised, source = self.normaliser(text)
        split = [self._split(s) for s in self._segments(normalised)]
        ids = np.concatenate([s[0] for s in split])
        ends = np.cumsum(np.concatenate([s[1] for s in split]), dtype=np.int64)
        return ids, source[np.concatenate([[0], ends[:-1]])[:len(ids)].astype(np.int64)], source[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_LOADED: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """One model per Python worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def shared(spark: SparkSession, file: str):
    """The bytes of a tokenizer file of the driver, broadcast."""
    with open(file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def parts(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to ``limit`` at most; a larger row is a range of its own."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """int32 lists, one per row."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
           end_id: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, starts, ends (byte spans in the text, end exclusive) of every whole text."""
    model = shared(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        eos = [pieces.library.eos_id()] if end_id and pieces.library.eos_id() >= 0 else []
        for rb in batches:
            texts = rb.column("text").to_pylist()
            for a, b in parts([len(t or "") for t in texts]):
                ids, starts, ends = [], [], []
                for t in texts[a:b]:
                    i, s, e = pieces.spans(t or "")
                    size = [len((t or "").encode())] * len(eos)
                    ids.append(np.append(i, eos))
                    starts.append(np.append(s, size))
                    ends.append(np.append(e, size))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rb.column("doc_id").slice(a, b - a), "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids": _lists(ids), "starts": _lists(starts), "ends": _lists(ends)})

    src = only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_file: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids and ``carry`` of the rows of ``encode``, with ``decoded``: the text of their ids (none: empty)."""
    model = shared(encoded.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for rb in batches:
            column = rb.column("ids")
            ids, at = column.values.to_numpy(), column.offsets.to_numpy()
            for a, b in parts(np.diff(at).tolist()):
                texts = [pieces.decode(ids[at[k]:at[k + 1]].tolist()) for k in range(a, b)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in rb.columns), pa.array(texts, pa.string())],
                                                 names=[*rb.schema.names, "decoded"])

    e = encoded.select("doc_id", "n_tokens", "ids", *carry)
    return e.mapInArrow(run, T.StructType([*e.schema.fields, T.StructField("decoded", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole document, the bytes their spans cover, and the decoded text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    e = encode(table(spark, sf_dir, "documents"), model)
    e = e.withColumn("span_bytes", F.expr("aggregate(zip_with(ends, starts, (e, s) -> e - s), 0L, (n, x) -> n + x)"))
    out = decode(e, model, carry=("span_bytes",))
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), "span_bytes")


SQL = None
