"""SentencePiece encoding that keeps offsets: every piece is projected to the bytes of the original text it came from.

Texts are normalised here, a batch at a time: at every character the longest key of the model's compiled
character map (a double array trie) is taken, all positions step by step at once; white space is then
collapsed, prefixed and escaped as the model's settings say. Every normalised byte remembers where its source
unit began. The library segments these normalised texts with its own normaliser switched off, so ids depend on
what was made here, and piece lengths add up to spans in the normalised text, which the alignment takes back
to spans in the original.

Where no piece of a model holds a space behind another character, its merges never cross the start of a word. The
library then segments every different word of a batch once, and the texts take the ids of their words; with
other models, and those without byte pieces, whose unknown pieces grow across words, it segments whole texts.

A piece's span begins where its first byte's source unit begins and ends where the next piece's begins. So the
spans of a text follow each other without gaps or overlaps; the added leading space has an empty span, and of
the byte pieces of one character all but the last do. Collapsed or trimmed white space belongs to the piece
before it, at the beginning of a text to none.

Defined results: null is the empty text, without pieces; bytes that are no UTF-8 are normalised as U+FFFD each;
whole texts of any length are encoded at once; rows are encoded one by one, so repeated and missing ids stay as
they are; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import pieces, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RESULT = "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])
# Field numbers of the model file's messages, and its kinds of pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _KIND, _UNKNOWN, _USER, _BYTE = 1, 3, 2, 4, 6
_MODEL_TYPE, _BPE = 3, 2
_WHITESPACE_AS_SUFFIX, _CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 24, 2, 3, 4, 5
_SPACE, _REPLACEMENT = "\u2581".encode(), "\ufffd".encode()


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value: bool | bytes) -> bytes:
    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, bool) else varint(number << 3 | 2) + varint(len(value)) + value


def _utf8_sizes(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Size of the valid character at each byte, 0 where none begins; `end` is where each byte's text ends."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(3, np.uint8)))
    a, b, c, d = (wide[k : k + n] for k in range(4))
    left = end - np.arange(n)
    trail = [(x & 0xC0) == 0x80 for x in (b, c, d)]
    size = (a < 0x80).astype(np.int8)
    size[(a >= 0xC2) & (a < 0xE0) & trail[0] & (left >= 2)] = 2
    three = (a & 0xF0 == 0xE0) & trail[0] & trail[1] & (left >= 3)
    size[three & ~((a == 0xE0) & (b < 0xA0)) & ~((a == 0xED) & (b >= 0xA0))] = 3
    four = (a >= 0xF0) & (a <= 0xF4) & trail[0] & trail[1] & trail[2] & (left >= 4)
    size[four & ~((a == 0xF0) & (b < 0x90)) & ~((a == 0xF4) & (b >= 0x90))] = 4
    return size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start[0], start[0] + 1, ... of all spans one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _spaces(piece: bytes) -> int:
    """How many escaped spaces a piece begins with."""
    n = 0
    while piece.startswith(_SPACE, n * len(_SPACE)):
        n += 1
    return n


def _valid(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether every text is UTF-8: all of them together are, and none begins within a character."""
    begins = offsets[:-1][offsets[:-1] < len(data)]
    if ((data[begins] & 0xC0) == 0x80).any():
        return False
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


class CharacterMap:
    """The compiled character map: a double array trie over UTF-8 keys, and the strings they become."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = np.frombuffer(compiled[4 + size :], np.uint8)
        stops = np.flatnonzero(self.strings == 0)
        self.stop = np.append(stops, len(self.strings))

    @staticmethod
    def _children(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key at each of the places `at` (0: none), and where its string begins."""
        length, string = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.units):
            return length, string
        open_, node = np.arange(len(at)), np.full(len(at), self._children(self.units[:1])[0])
        for k in range(int((end - at).max(initial=0))):
            inside = at[open_] + k < end[open_]
            open_, node = open_[inside], node[inside]
            if not len(open_):
                break
            label = data[at[open_] + k].astype(np.int64)
            node = node ^ label
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            fits = (node < len(self.units)) & (unit & ((1 << 31) | 0xFF) == label)
            open_, node, unit = open_[fits], node[fits], unit[fits]
            node = node ^ self._children(unit)
            ends_here = (unit >> 8) & 1 == 1
            length[open_[ends_here]] = k + 1
            string[open_[ends_here]] = self.units[node[ends_here]] & ((1 << 31) - 1)
        return length, string

    def sizes(self, string: np.ndarray) -> np.ndarray:
        return self.stop[np.searchsorted(self.stop, string)] - string


class Model:
    """What encoding needs of a model file: normalisation settings, and lengths of pieces."""

    def __init__(self, held: bytes):
        self.held = held
        top = list(fields(held))
        self.pieces = [dict(fields(v)) for k, v in top if k == _PIECES]
        trainer = dict(x for k, v in top if k == _TRAINER for x in fields(v))
        settings = dict(x for k, v in top if k == _NORMALIZER for x in fields(v))
        self.map = CharacterMap(settings.get(_CHARSMAP) or bytes(4))
        self.prefix, self.remove_extra, self.escape = (bool(settings.get(k, 1)) for k in (_DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE))
        self.as_suffix = bool(trainer.get(_WHITESPACE_AS_SUFFIX, 0))
        own = sorted((p[_PIECE] for p in self.pieces if p.get(_KIND, 1) == _USER), key=len, reverse=True)
        self.own = re.compile(b"(?=(" + b"|".join(map(re.escape, own)) + b"))", re.S) if own else None
        #: Bytes of normalised text a piece stands for; the unknown piece's depend on the text.
        self.size = np.array([1 if p.get(_KIND, 1) == _BYTE else 0 if p.get(_KIND, 1) == _UNKNOWN else len(p[_PIECE]) for p in self.pieces], np.int64)
        self.has_bytes = any(p.get(_KIND, 1) == _BYTE for p in self.pieces)
        #: Whether words are segmented alike alone and within their text.
        self.by_words = self.has_bytes and trainer.get(_MODEL_TYPE, 1) == _BPE and not any(_SPACE in p[_PIECE][len(_SPACE) * _spaces(p[_PIECE]) :] for p in self.pieces)

    @cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.held)

    @cached_property
    def segmenter(self):
        """The same model with a normaliser that changes nothing."""
        import sentencepiece

        rest = b"".join(_field(k, v) for k, v in fields(self.held) if k != _NORMALIZER)
        plain = _field(1, b"identity") + b"".join(_field(k, False) for k in (_DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE))
        return sentencepiece.SentencePieceProcessor(model_proto=rest + _field(_NORMALIZER, plain))

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes and offsets of a batch of texts, the source of each byte, and where each text's source ends, within the batch."""
        count = len(offsets) - 1
        doc = np.repeat(np.arange(count), np.diff(offsets))
        if not len(self.map.units) and self.own is None and _valid(data, offsets):
            return self._unchanged(data, doc, offsets)
        end = offsets[1:][doc]
        size = _utf8_sizes(data, end).astype(np.int64)
        whole = size > 0
        inner = np.zeros(len(data), bool)
        for k in (1, 2, 3):
            inner[np.flatnonzero(size > k) + k] = True
        at = np.flatnonzero(~inner)
        taken = np.maximum(size[at], 1)
        key, string = self.map.longest(data, at, end[at])
        mapped = key > 0
        taken = np.where(mapped, key, taken)
        # the model's own symbols are units of themselves, before any key of the map
        symbol, long = self._own_units(data, offsets)
        place = np.searchsorted(at, symbol)
        taken[place], mapped[place] = long, False
        # of keys longer than a character, the first in order wins; what lies inside it is no unit
        kept = np.ones(len(at), bool)
        after = np.searchsorted(at, at + taken)
        reach = 0
        for k in np.flatnonzero(after > np.arange(len(at)) + 1):
            if k >= reach:
                reach = after[k]
                kept[k + 1 : reach] = False
        at, taken, mapped, string = at[kept], taken[kept], mapped[kept], string[kept]
        # source of what each unit becomes: the texts, then the map's strings, then U+FFFD
        source = np.concatenate((data, self.map.strings, np.frombuffer(_REPLACEMENT, np.uint8)))
        broken = ~mapped & ~whole[at]
        begin = np.where(mapped, len(data) + string, np.where(broken, len(source) - 3, at))
        length = np.where(broken, 3, taken)
        length[mapped] = self.map.sizes(string[mapped])
        out = source[_spread(begin, length)]
        align, of = np.repeat(at, length), np.repeat(doc[at] if len(at) else at, length)
        # the first unit of each text that is no space: the added space belongs there
        lead = offsets[:-1].copy()
        if self.remove_extra and len(at):
            solid = np.flatnonzero((length != 1) | (source[np.minimum(begin, len(source) - 1)] != 0x20))
            texts, first = np.unique(doc[at[solid]], return_index=True)
            lead[texts] = at[solid[first]]
        return self._spaced(out, align, of, offsets, lead)

    def _unchanged(self, data: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`normalise` where every unit is a character that stays as it is."""
        align = np.arange(len(data))
        if len(data) and data.max() >= 0x80:
            align = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, align))
        lead = offsets[:-1].copy()
        if self.remove_extra:
            solid = np.flatnonzero(data != 0x20)
            texts, first = np.unique(doc[solid], return_index=True)
            lead[texts] = solid[first]
        return self._spaced(data, align, doc, offsets, lead)

    def _own_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the model's own symbols stand, and their lengths."""
        found = [(a + m.start(), len(m[1])) for a, b in zip(offsets[:-1], offsets[1:], strict=True) for m in self.own.finditer(data[a:b].tobytes())] if self.own else []
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def _spaced(self, out: np.ndarray, align: np.ndarray, of: np.ndarray, offsets: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """White space collapsed and trimmed, a space put before or after, spaces escaped."""
        count, stop = len(offsets) - 1, offsets[1:].copy()
        if self.remove_extra and len(out):
            space = out == 0x20
            first = np.ones(len(out), bool)
            first[1:] = of[1:] != of[:-1]
            before = np.concatenate(([False], space[:-1]))
            keep = ~space | ~(first | before)
            last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
            # a text's trailing space, if one is left, goes, and its source ends there
            run = np.where(space, 0, np.arange(len(out)) + 1)
            final = np.maximum.reduceat(run, np.flatnonzero(first))
            tail = last[space[last]]
            begin = np.maximum(final, np.flatnonzero(first))
            for k in tail:
                d = np.searchsorted(last, k)
                stop[of[k]] = align[begin[d]]
                keep[begin[d] : k + 1] = False
            out, align, of = out[keep], align[keep], of[keep]
        held = np.bincount(of, minlength=count)
        some = held > 0 if self.remove_extra else np.diff(offsets) > 0
        bounds = np.concatenate(([0], np.cumsum(held)))
        if self.prefix:
            where = (bounds[1:] if self.as_suffix else bounds[:-1])[some]
            source = (stop if self.as_suffix else lead)[some]
            out, align = np.insert(out, where, 0x20), np.insert(align, where, source)
            bounds[1:] += np.cumsum(some)
        if self.escape:
            at, more = np.flatnonzero(out == 0x20), len(_SPACE) - 1
            out = np.frombuffer(out.tobytes().replace(b" ", _SPACE), np.uint8)
            align = np.insert(align, np.repeat(at, more), np.repeat(align[at], more))
            bounds += more * np.searchsorted(at, bounds)
        return out, bounds, align, stop

    def _segmented(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        ids = self.segmenter.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, counts.sum()), counts

    def _word_starts(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where a text begins, or a space behind another character."""
        space = np.zeros(len(text) + 3, bool)
        space[3 : len(text) + 1] = (text[:-2] == _SPACE[0]) & (text[1:-1] == _SPACE[1]) & (text[2:] == _SPACE[2])
        begins = space[3:] & ~space[:-3]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(begins)

    def _segmented_by_words(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`_segmented` for normalised texts, by their different words."""
        starts = self._word_starts(text, bounds)
        places = pa.py_buffer(np.append(starts, len(text)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(text)]).dictionary_encode()
        ids, counts = self._segmented(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        word = words.indices.to_numpy()
        first = np.concatenate(([0], np.cumsum(counts)))
        before = np.concatenate(([0], np.cumsum(counts[word])))
        return ids[_spread(first[word], counts[word])], np.diff(before[np.searchsorted(starts, bounds)])

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, how many each has, and start and end of all pieces, in bytes from the start of their text."""
        text, bounds, align, stop = self.normalise(data, offsets)
        if self.by_words:
            flat, counts = self._segmented_by_words(text, bounds)
        else:
            whole = text.tobytes()
            parts = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            flat, counts = self._segmented(parts)
        size = self.size[flat]
        if not self.has_bytes and (size == 0).any():
            said = self.segmenter.encode(parts, out_type=str, num_threads=1)
            size = np.fromiter((len(p.encode()) for x in said for p in x), np.int64, len(flat))
        end = np.cumsum(size)
        got = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts)))]
        if (got != bounds).any():
            raise ValueError("pieces do not cover the normalised text")
        doc = np.repeat(np.arange(len(counts)), counts)
        source = np.append(align, 0)
        start_at = source[end - size] if len(end) else end
        end_at = np.where(end == bounds[1:][doc], stop[doc], source[end]) if len(end) else end
        return flat, counts, start_at - offsets[:-1][doc], end_at - offsets[:-1][doc]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of each text, and start and end of all pieces one after the other, in bytes from the start of their text."""
        flat, counts, starts, ends = self.encode_flat(data, offsets)
        return _lists(flat, counts), starts, ends


def _lists(flat: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    at = np.concatenate(([0], np.cumsum(counts))).tolist()
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


_made: dict[int, Model] = {}


def _model(held: bytes) -> Model:
    key = hash(held)
    if key not in _made:
        _made[key] = Model(held)
    return _made[key]


def encode_pieces(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """Per document: ids, source spans (bytes) of the pieces, and the text decoded from the ids. `model` is a file on the driver, sent along."""
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches):
        own = _model(held.value)
        for batch in batches:
            for piece in pieces(batch, "text", block):
                ids, counts, starts, ends = own.encode_flat(*text_bytes(piece["text"]))
                at = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((ids, pa.int32()), (starts, pa.int64()), (ends, pa.int64()))]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], *lists, pa.array(map(own.library.decode, _lists(ids, counts)), pa.string())], schema=_RESULT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, RESULT)
