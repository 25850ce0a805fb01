"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's characters are its first symbols. The agenda holds every pair of adjacent symbols whose concatenation is a piece; the pair of the highest score is
merged first, of equal scores the leftmost, until none is left. No merge joins two characters that stand side by side in no piece, so texts are cut between such
characters, and each different segment is encoded once for many texts: short ones all together, a step of every segment's agenda at a time, long ones from
a heap. The library encodes the same texts, and a difference is an error.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_name, map_arrow

#: The mark that stands for a blank in pieces, and the names of a byte's piece; fixed by the format.
BLANK = "▁"
_BYTE = "<0x{:02X}>"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE_TYPE = 1, 2, 3, 6
#: Segments up to so many characters are merged together; for longer ones, a heap saves the square.
SHORT = 40
#: Different segments that a task remembers; then it starts anew.
REMEMBERED = 1 << 19
#: Characters of a text that are cut into segments at a time.
PART_CHARS = 1 << 20
#: Characters of a passage that the library encodes for comparison, about.
PASSAGE = 100


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; four and eight bytes wide ones stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


@dataclass
class Vocabulary:
    """Pieces, scores and types of a model file, and what encoding and decoding need of its settings. Only merge-type models whose normaliser changes nothing but blanks are read."""

    data: bytes
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    unknown: int = 0
    byte_fallback: bool = False
    dummy_prefix: bool = True
    surface: str = " ⁇ "

    def __post_init__(self) -> None:
        kind, charsmap, extra, escape, suffix = 1, b"", 1, 1, 0
        for number, value in _fields(self.data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
                self.types.append(own.get(3, _NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                kind, suffix = own.get(3, 1), own.get(24, 0)
                self.byte_fallback = bool(own.get(35, 0))
                self.surface = own.get(44, self.surface.encode()).decode()
            elif number == 3:
                own = dict(_fields(value))
                charsmap, extra, escape = own.get(2, b""), own.get(4, 1), own.get(5, 1)
                self.dummy_prefix = bool(own.get(3, 1))
        if kind != 2:
            raise ValueError("not a merge-type model")
        if charsmap or extra or not escape or suffix:
            raise ValueError("a model whose normaliser changes more than blanks")
        if set(self.types) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE_TYPE}:
            raise ValueError("a model with unused or user-defined pieces")
        self.unknown = self.types.index(_UNKNOWN)

    @cached_property
    def symbols(self) -> dict[str, int]:
        """Number of each symbol: ids of normal pieces, and numbers beyond the ids for characters that are only parts of pieces."""
        out = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == _NORMAL}
        for p in list(out):
            for c in p:
                out.setdefault(c, len(self.pieces) + len(out))
        return out

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs of symbols that make a piece, ascending, and the pieces."""
        symbols, found = self.symbols, {}
        for p, i in symbols.items():
            if len(p) > 1:
                for cut in range(1, len(p)):
                    a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                    if a is not None and b is not None:
                        found[a << 32 | b] = i
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    @cached_property
    def score(self) -> np.ndarray:
        return np.array(self.scores, np.float32)

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each code point, 0 for those of no piece of several characters, and a table of which two may stand side by side in a piece."""
        long = [p for p, t in zip(self.pieces, self.types, strict=True) if t == _NORMAL and len(p) > 1]
        number = np.zeros(0x110000, np.int32)
        letters = sorted({ord(c) for p in long for c in p})
        number[letters] = np.arange(1, len(letters) + 1)
        table = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = sorted({p[i : i + 2] for p in long for i in range(len(p) - 1)})
        ends = number[np.frombuffer("".join(pairs).encode("utf-32-le"), "<u4")].reshape(-1, 2)
        table[ends[:, 0], ends[:, 1]] = True
        return number, table

    def starts(self, letters: np.ndarray) -> np.ndarray:
        """Whether a segment starts at each code point: a merge across two characters would make a piece that holds both side by side, so a text is cut between two that no piece does."""
        number, table = self.joins
        at = number[letters]
        return np.concatenate([[True], ~table[at[:-1], at[1:]]])

    @cached_property
    def said(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What each id adds to a decoded text, whether it starts with a blank mark, and whether it is a control piece."""
        out, blank = [], np.zeros(len(self.pieces), bool)
        for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)):
            blank[i] = t == _NORMAL and p.startswith(BLANK)
            out.append({_CONTROL: b"", _UNKNOWN: self.surface.encode()}.get(t, bytes([int(p[3:5], 16)]) if t == _BYTE_TYPE else p.replace(BLANK, " ").encode()))
        return pa.array(out, pa.large_binary()), blank, np.array(self.types) == _CONTROL

    @cached_property
    def of_bytes(self) -> list[int]:
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == _BYTE_TYPE}
        return [ids[_BYTE.format(b)] for b in range(256)] if self.byte_fallback else []

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys, pieces = self.pairs
        if not len(keys):
            return np.full(left.shape, -1, np.int64)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), pieces[at], -1)

    @cached_property
    def of_char(self) -> np.ndarray:
        """Symbol of each code point, -1 for a character of no piece."""
        out = np.full(0x110000, -1, np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    def together(self, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which segments, their symbols) of segments of one length, as they are done; -1 is a character of no piece. Every round takes the best pair of each segment's agenda."""
        n, width = len(segments), len(segments[0])
        now = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")].reshape(n, width).astype(np.int64)
        rows = np.arange(n)
        if width == 1:
            yield rows, now
            return
        made = self.merged(now[:, :-1], now[:, 1:])
        agenda = np.where(made >= 0, self.score[made], -np.inf)
        while True:
            best = agenda.argmax(1)
            on = agenda[np.arange(len(rows)), best] > -np.inf
            if not on.all():
                yield rows[~on], now[~on]
                if not on.any():
                    return
                rows, now, made, agenda, best = rows[on], now[on], made[on], agenda[on], best[on]
            each, width = np.arange(len(rows)), width - 1
            now[each, best] = made[each, best]
            # All that stands to the right of the pair moves up by one.
            now = np.take_along_axis(now, np.arange(width) + (np.arange(width) > best[:, None]), 1)
            if width == 1:
                yield rows, now
                return
            pair = np.arange(width - 1) + (np.arange(width - 1) >= best[:, None])
            made, agenda = np.take_along_axis(made, pair, 1), np.take_along_axis(agenda, pair, 1)
            for at in (best - 1, best):
                r = np.flatnonzero((at >= 0) & (at < width - 1))
                a = at[r]
                made[r, a] = p = self.merged(now[r, a], now[r, a + 1])
                agenda[r, a] = np.where(p >= 0, self.score[p], -np.inf)

    def alone(self, segment: str) -> list[int]:
        """Symbols of one segment, from a heap of (score, left symbol, right symbol); pairs of which a side has gone or grown are passed over."""
        number, (keys, pieces) = self.symbols, self.pairs
        known = self.__dict__.setdefault("_known", dict(zip(keys.tolist(), pieces.tolist(), strict=True)))
        now = [number.get(c, -1) for c in segment]
        before, after = list(range(-1, len(now) - 1)), [*range(1, len(now)), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def add(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and now[a] >= 0 and now[b] >= 0 and (p := known.get(now[a] << 32 | now[b])) is not None:
                heapq.heappush(agenda, (-self.scores[p], a, b, now[a], now[b]))

        for i in range(len(now) - 1):
            add(i, i + 1)
        while agenda:
            _, a, b, x, y = heapq.heappop(agenda)
            if now[a] != x or now[b] != y or after[a] != b:
                continue
            now[a], now[b] = known[x << 32 | y], -2
            after[a] = c = after[b]
            if c >= 0:
                before[c] = a
            add(before[a], a)
            add(a, c)
        return [s for s in now if s != -2]

    def ids(self, segment: str, symbols: list[int]) -> list[int]:
        """Ids of a segment's symbols: a character of no piece is its bytes, or with no byte pieces the unknown id, once for a run."""
        out, at, before = [], 0, -1
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
                at += len(self.pieces[s])
            else:
                if self.byte_fallback:
                    out += [self.of_bytes[b] for b in segment[at].encode()]
                elif before != self.unknown:
                    out.append(self.unknown)
                at += 1
            before = out[-1]
        return out

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and how many each has."""
        by: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by.setdefault(len(s) if len(s) <= SHORT else 0, []).append(i)
        size, done = np.zeros(len(segments), np.int64), []
        lists = [(i, self.ids(segments[i], self.alone(segments[i]))) for i in by.pop(0, [])]
        for rows in by.values():
            for at in range(0, len(rows), 1 << 14):
                part = np.array(rows[at : at + (1 << 14)])
                for r, symbols in self.together([segments[i] for i in part]):
                    odd = ((symbols < 0) | (symbols >= len(self.pieces))).any(1)
                    lists += [(i, self.ids(segments[i], x)) for i, x in zip(part[r[odd]].tolist(), symbols[odd].tolist(), strict=True)]
                    done.append((part[r[~odd]], symbols[~odd]))
                    size[part[r[~odd]]] = symbols.shape[1]
        for i, x in lists:
            size[i] = len(x)
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for rows, symbols in done:
            out[start[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        for i, x in lists:
            out[start[i] : start[i] + len(x)] = x
        return out, size


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


_read: dict[int, tuple[bytes, Vocabulary]] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of a model file's bytes, read once in each worker."""
    held = _read.get(len(data))
    if held is None or held[0] != data:
        held = _read[len(data)] = (data, Vocabulary(data))
    return held[1]


class Encoder:
    """Encodes batches of texts; segments it has seen are remembered."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.first = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        found, size = self.voc.encoded(fresh)
        at = len(self.number)
        self.number.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        if len(self.number) >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros(len(self.number) + 1, np.int64)])
        used = int(self.first[at])
        ends = used + np.cumsum(size)
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(int(ends[-1]), np.int32)])
        self.first[at + 1 : at + 1 + len(fresh)] = ends
        self.flat[used : ends[-1]] = found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; no begin or end ids."""
        out, counts, held, owners, chars = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            ends = np.cumsum(list(map(len, held)))
            joined = "".join(held)
            letters = _letters(joined)
            mask = self.voc.starts(letters)
            mask[ends[:-1]] = True
            starts = np.flatnonzero(mask)
            # Where the segments start in UTF-8; only different ones become Python strings.
            data = joined.encode()
            first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            offsets = np.append(first[starts], len(data)).astype(np.int32)
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
            segments = words.dictionary.to_pylist()
            if fresh := [s for s in segments if s not in self.number]:
                if len(self.number) > REMEMBERED:
                    self._clear()
                    fresh = segments
                self._learn(fresh)
            at = np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))[words.indices.to_numpy()]
            size = self.first[at + 1] - self.first[at]
            sums = np.cumsum(size)
            out.append(self.flat[np.repeat(self.first[at] - sums + size, size) + np.arange(sums[-1])])
            np.add.at(counts, owners, np.add.reduceat(size, np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            text, at = ((BLANK if self.voc.dummy_prefix else "") + text.replace(" ", BLANK), 0) if text else ("", 0)
            while at < len(text):
                end = min(at + PART_CHARS - chars, len(text))
                # A long text goes on where a segment starts, which is looked for in the next characters.
                while end < len(text) and not (cuts := self.voc.starts(_letters(text[end - 1 : end + PART_CHARS]))[1:]).any():
                    end = min(end + PART_CHARS, len(text))
                if end < len(text):
                    end += int(cuts.argmax())
                held.append(text[at:end])
                owners.append(i)
                chars += end - at
                at = end
                if chars >= PART_CHARS:
                    flush()
                    chars = 0
        if held:
            flush()
        return np.concatenate([*out, np.empty(0, np.int32)]), counts


def decoded(voc: Vocabulary, ids: pa.Array) -> pa.Array:
    """Texts of a list array of ids: one leading blank of the first piece goes, byte pieces join to characters, bytes that make none become U+FFFD each."""
    said, blank, control = voc.said
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= len(voc.pieces)):
        raise ValueError("an id that the vocabulary doesn't have")
    ends = np.cumsum(size)
    words = said.take(pa.array(flat))
    at = np.frombuffer(words.buffers()[1], np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
    data = bytes(words.buffers()[2] or b"") if len(flat) else b""
    hidden = control[flat]
    plain = not hidden.any()
    shown = np.flatnonzero(~hidden) if not plain else np.empty(0)
    out = []
    for s, e in zip((ends - size).tolist(), ends.tolist(), strict=True):
        text = data[at[s] : at[e]]
        if plain:
            if voc.dummy_prefix and s < e and blank[flat[s]]:
                text = text[1:]
            try:
                out.append(text.decode())
            except UnicodeDecodeError:
                out.append(_each(text))
            continue
        k = int(np.searchsorted(shown, s))
        if int(np.searchsorted(shown, e)) - k < e - s:
            # Bytes on either side of a control piece don't join.
            runs = np.split(np.arange(s, e), np.flatnonzero(control[flat[s:e]]))
            strip = voc.dummy_prefix and k < len(shown) and shown[k] < e and blank[flat[shown[k]]]
            out.append("".join(_each(data[at[r[0]] : at[r[-1] + 1]]) for r in runs if len(r))[int(strip) :])
            continue
        if voc.dummy_prefix and k < len(shown) and shown[k] < e and blank[flat[shown[k]]]:
            text = text[1:]
        try:
            out.append(text.decode())
        except UnicodeDecodeError:
            out.append(_each(text))
    return pa.array(out, pa.string())


def _each(data: bytes) -> str:
    """data as UTF-8, with U+FFFD for each byte that is part of no character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _passages(texts: list[str], voc: Vocabulary) -> Iterator[str]:
    """texts in passages of about PASSAGE characters, for the library, whose agenda takes longer for long ones: cut before a blank, which is the mark that the library sets before each passage anyway. Whole texts where pieces go on over blanks."""
    number, table = voc.joins
    whole = not voc.dummy_prefix or table[:, number[ord(BLANK)]][np.arange(len(table)) != number[ord(BLANK)]].any()
    for text in texts:
        at = 0
        end = -1 if whole else text.find(" ", PASSAGE)
        while 0 <= end < len(text) - 1:
            if text[end - 1] in (" ", BLANK):
                end = text.find(" ", end + 1)
                continue
            yield text[at:end]
            at = end + 1
            end = text.find(" ", at + PASSAGE)
        yield text[at:]


def _ids_of(texts: list[str], encoder: Encoder, library) -> tuple[pa.Array, list[int] | None]:
    """Lists of ids, and with a library, which they are compared with, all of them as one list."""
    ids, counts = encoder.encode(texts)
    ends, flat = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), None
    if library:
        flat = ids.tolist()
        if list(chain.from_iterable(library.encode(list(_passages(texts, encoder.voc)), num_threads=1))) != flat:
            raise ValueError("ids that differ from the library's")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())), flat


def _texts_of(lists: pa.Array, voc: Vocabulary, library, flat: list[int] | None = None) -> pa.Array:
    """Texts of lists of ids, compared with a library's if there is one. flat: all ids, if they are known as a list."""
    texts = decoded(voc, lists)
    if library:
        flat, ends = flat or lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
        if [library.decode(flat[s:e]) for s, e in zip(ends, ends[1:], strict=False)] != texts.to_pylist():
            raise ValueError("a text that differs from the library's")
    return texts


def _batch(b: pa.RecordBatch, kept: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *more.values()], names=[*kept, *more])


def _columns(rows: DataFrame, kept: list[str], *more: str) -> str:
    types = dict(rows.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in kept), *more])


def encode(spark: SparkSession, rows: DataFrame, model: str, text: str = "text", out: str = "ids", check: bool = True) -> DataFrame:
    """rows with column out (array<int>, replaced if there) instead of text: the ids of each whole text, without begin and end ids.

    A null or empty text has no ids. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows all stay, other columns are passed on, and an empty table stays empty.
    model is a file that the driver reads; it is sent to the executors. check compares each batch with the library, and raises ValueError where they differ.
    """
    data = spark.sparkContext.broadcast(Path(model).read_bytes())
    vocabulary(data.value)
    kept = [c for c in rows.columns if c.lower() not in (text.lower(), out.lower())]
    held = distinct_name(rows.select(*kept), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = Encoder(vocabulary(data.value)), _library(data.value) if check else None
        for b in batches:
            yield _batch(b, kept, **{out: _ids_of(_texts(b.column(len(kept))), encoder, library)[0]})

    return map_arrow(rows.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(held)), run, _columns(rows, kept, f"`{out}` array<int>"))


def decode(spark: SparkSession, rows: DataFrame, model: str, ids: str = "ids", out: str = "text", check: bool = True) -> DataFrame:
    """rows with column out (string, replaced if there): the text of each array of ids; null or empty ids give an empty text, an id that isn't there an error. check as in encode."""
    data = spark.sparkContext.broadcast(Path(model).read_bytes())
    kept = [c for c in rows.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, library = vocabulary(data.value), _library(data.value) if check else None
        for b in batches:
            yield _batch(b, kept, **{out: _texts_of(b.column(kept.index(ids)).fill_null([]), voc, library)})

    return map_arrow(rows.select(*(F.col(f"`{c}`") for c in kept)), run, _columns(rows, kept, f"`{out}` string"))


def round_trip(spark: SparkSession, rows: DataFrame, model: str, text: str = "text", ids: str = "ids", out: str = "decoded", check: bool = True) -> DataFrame:
    """encode, then decode into column out, of the same batch in one task: rows with ids and out instead of text."""
    data = spark.sparkContext.broadcast(Path(model).read_bytes())
    vocabulary(data.value)
    kept = [c for c in rows.columns if c.lower() not in (text.lower(), ids.lower(), out.lower())]
    held = distinct_name(rows.select(*kept), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = Encoder(vocabulary(data.value)), _library(data.value) if check else None
        for b in batches:
            lists, flat = _ids_of(_texts(b.column(len(kept))), encoder, library)
            yield _batch(b, kept, **{ids: lists, out: _texts_of(lists, encoder.voc, library, flat)})

    return map_arrow(rows.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(held)), run, _columns(rows, kept, f"`{ids}` array<int>", f"`{out}` string"))
