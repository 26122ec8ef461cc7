"""Phrase collocations by position bitmaps: phrases grow by shift, AND and popcount, depth first, shard by shard.

A shard is a run of texts of one language, some 16 MB, written once. In it every frequent word has a bitmap of
its positions, compressed to the chunks of 16 positions that hold a bit (so short that few words share one). The words of a piece stand at consecutive
positions and pieces have a gap between them, so a phrase that is moved on by one position meets its next words
by AND, within its piece, and the popcount of what is left is the longer phrase's count in the shard. Blocks
of phrases are extended at once, each to its full length before the next block is taken up.

Whether a phrase is frequent only the sum over shards tells. So shards send fingerprints and popcounts of their
phrases, length by length, packed for ranges of the fingerprint; what reaches `min_count` is told back to the
shards that hold it, and only such phrases are extended, by words that end such phrases themselves. Most phrases
are rare, so shards first send popcounts by the fingerprints' first 32 bits, as gaps, and then only the phrases
whose 32 bits reach `min_count`, which all frequent ones do. Sums are by
96 bits; of each frequent phrase one shard is told the sum and spells it out at the end. Nothing is cut off by
size: shards, ranges and blocks bound memory, not results.

Defined results: null and empty texts and texts of separators alone have no words; a missing language is `und`;
repeated rows count once each, with or without ids; whole texts of any length are used, a text is never cut
between shards; ties go to the smaller phrase in byte order; columns other than text and language are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import LOWER, Words, mix, pieces, text_bytes

#: A fingerprint and what tells equal ones of different phrases apart.
U64, CHECK = np.uint64, np.uint32
#: A chunk of a bitmap: its type, and the positions it has as a power of two.
CHUNK, WIDTH = np.uint16, 4
_SHARD = "id long, lang string, n long, words binary, counts binary, tokens binary"
_SHARDS = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_BITMAP = "id long, lang string, words binary, word binary, chunk binary, bits binary"
_BITMAPS = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("word", pa.binary()), ("chunk", pa.binary()), ("bits", pa.binary())])
_SEND = "part long, id long, keys binary, checks binary, counts binary"
_SENT = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("counts", pa.binary())])
_CELL = "part long, id long, cells binary, counts binary"
_CELLS = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
_FULL = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("keys", pa.binary())])
_TELL = "id long, length int, keys binary, own_keys binary, own_checks binary, own_sums binary"
_FOUND = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("keys", pa.binary()), ("own_keys", pa.binary()), ("own_checks", pa.binary()), ("own_sums", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("phrase", pa.binary()), ("a", pa.int64())])
_STEP = U64(0x9E3779B97F4A7C15)

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _ENDS.copy()
_BREAKS[[0x20, 0x09]] = True
_SPACES = np.zeros(256, bool)
_SPACES[0x20] = True


def _packed(values: np.ndarray) -> bytes:
    """Size and compressed bytes of an array, all first bytes first: small numbers then compress well."""
    held = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(held.view(np.uint8).reshape(len(held), held.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(held: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(held[:8], "little")
    planes = np.frombuffer(pa.decompress(held[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _hashes(joined: bytes, family: int = 0) -> np.ndarray:
    """Fingerprints of words that stand with a space after each."""
    data = np.frombuffer(joined, np.uint8)
    return Words(data, np.array([0, len(data)]), _SPACES).hashes(family)


def _seed(lang: str) -> U64:
    """What tells the phrases of languages apart."""
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _grown(keys: np.ndarray | U64, words: np.ndarray) -> np.ndarray:
    """Fingerprints of phrases with a word more."""
    return mix(np.multiply(np.atleast_1d(keys), _STEP) + words)


def _span(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _held(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted `of`."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def _shard(lang: str, texts: pa.Array, id_: int) -> pa.RecordBatch | None:
    """The words of texts as numbers, in order, with a zero between pieces."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    words = Words(data, offsets, _BREAKS)
    n = len(words.starts)
    if not n:
        return None
    inside = ~_BREAKS[data]
    size = (words.ends - words.starts).astype(np.int64)
    spelt = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
    # words are numbered by falling count, so that most numbers are small
    given = spelt.indices.to_numpy()
    counts = np.bincount(given, minlength=len(spelt.dictionary))
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(1, len(order) + 1)
    number_of = number[given]
    ends = np.concatenate(([0], np.cumsum(_ENDS[data])))
    gap = np.zeros(n, bool)
    gap[1:] = ends[words.starts[1:]] > ends[words.ends[:-1]]
    first = words.first[:-1][words.counts > 0]
    gap[first] = True
    tokens = np.zeros(n + int(gap.sum()), np.int32)
    tokens[np.arange(n) + np.cumsum(gap)] = number_of
    joined = b"".join(w + b" " for w in spelt.dictionary.take(pa.array(order)).to_pylist())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((id_, lang, n, joined, _packed(counts[order].astype(np.int32)), _packed(tokens)), _SHARDS.types, strict=True)], schema=_SHARDS)


def _shards(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        waiting: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def emit(lang):
            nonlocal made
            out = _shard(lang, pa.concat_arrays(waiting.pop(lang)), base + made)
            size.pop(lang)
            made += 1
            return [out] if out is not None else []

        for batch in batches:
            for piece in pieces(batch, "text", block):
                coded = piece["lang"].dictionary_encode()
                at = coded.indices.to_numpy()
                for k, lang in enumerate(coded.dictionary.to_pylist()):
                    texts = piece["text"].filter(pa.array(at == k)).cast(pa.large_binary())
                    waiting.setdefault(lang, []).append(texts)
                    size[lang] = size.get(lang, 0) + texts.nbytes
                    if size[lang] >= block:
                        yield from emit(lang)
            # texts of many languages wait at once: the largest go first
            while sum(size.values()) > 2 * block:
                yield from emit(max(size, key=size.get))
        for lang in list(waiting):
            yield from emit(lang)

    return cut


def _send(id_: int, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """A shard's fingerprints, their second parts and counts (mostly ones, so compressed), a row for each range of fingerprints."""
    order = np.argsort(keys)
    part = ((keys[order] >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    cut = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    spans = [order[cut[p] : cut[p + 1]] for p in full]
    return pa.table([pa.array(full, pa.int64()), pa.array(np.full(len(full), id_), pa.int64()), *(pa.array([f(x[s]) for s in spans], pa.binary()) for x, f in ((keys, np.ndarray.tobytes), (checks.astype(CHECK), np.ndarray.tobytes), (counts.astype(np.int64), _packed)))], schema=_SENT)


def _send_cells(id_: int, cells: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """A shard's counts by the first 32 bits of fingerprints, sorted and packed as gaps, a row for each range."""
    order = np.argsort(cells)
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
    cells, counts = cells[first], np.add.reduceat(counts, first) if len(first) else counts
    cut = np.searchsorted((cells * U64(parts) >> U64(32)).astype(np.int64), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    spans = [slice(cut[p], cut[p + 1]) for p in full]
    gaps = [_packed(np.diff(cells[s], prepend=U64(0))) for s in spans]
    return pa.table([pa.array(full, pa.int64()), pa.array(np.full(len(full), id_), pa.int64()), pa.array(gaps, pa.binary()), pa.array([_packed(counts[s]) for s in spans], pa.binary())], schema=_CELLS)


def _full(min_count: int) -> Callable[[pa.Table], pa.Table]:
    """For a range of fingerprints: the first 32 bits with enough in all shards, told to each shard that has them, as of phrases without words."""

    def tell(table: pa.Table) -> pa.Table:
        each = [np.cumsum(_unpacked(x, U64), dtype=U64) for x in table["cells"].to_pylist()]
        cells, counts = np.concatenate(each), np.concatenate([_unpacked(x, np.int64) for x in table["counts"].to_pylist()])
        order = np.argsort(cells)
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        often = cells[first][np.add.reduceat(counts, first) >= min_count]
        out = [(id_, 0, own[_held(own, often)].tobytes()) for id_, own in zip(table["id"].to_pylist(), each, strict=True)]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(_FULL.types)], schema=_FULL)

    return tell


def _frequent(min_count: int, length: int) -> Callable[[pa.Table], pa.Table]:
    """For a range of fingerprints: those with enough in all shards, told to each shard that has them, with their sums to the first."""

    def tell(table: pa.Table) -> pa.Table:
        each = [[read(x, kind) for x in table[c].to_pylist()] for c, kind, read in (("keys", U64, np.frombuffer), ("checks", CHECK, np.frombuffer), ("counts", np.int64, _unpacked))]
        keys, checks, counts = (np.concatenate(x) for x in each)
        row = np.repeat(np.arange(table.num_rows), [len(x) for x in each[0]])
        order = np.lexsort((row, checks, keys))
        keys, checks, counts, row = keys[order], checks[order], counts[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))))
        sums = np.add.reduceat(counts, first)
        first, sums = first[sums >= min_count], sums[sums >= min_count]
        often = np.unique(keys[first])
        out = []
        for k, (id_, own) in enumerate(zip(table["id"].to_pylist(), each[0], strict=True)):
            held, mine = own[_held(own, often)], row[first] == k
            if len(held):
                out.append((id_, length, held.tobytes(), keys[first[mine]].tobytes(), checks[first[mine]].tobytes(), sums[mine].tobytes()))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(_FOUND.types)], schema=_FOUND)

    return tell


def _told(found: pa.Table) -> dict[int, np.ndarray]:
    """The frequent fingerprints of a shard by length, sorted."""
    out: dict[int, list[np.ndarray]] = {}
    for length, keys in zip(found["length"].to_pylist(), found["keys"].to_pylist(), strict=True):
        out.setdefault(length, []).append(np.frombuffer(keys, U64))
    return {k: np.sort(np.concatenate(v)) for k, v in out.items()}


def _own(found: pa.Table) -> dict[int, dict[tuple[int, int], int]]:
    """The sums of the phrases that a shard is to spell, by length and fingerprint."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for length, *held in zip(*(found[c].to_pylist() for c in ("length", "own_keys", "own_checks", "own_sums")), strict=True):
        keys, checks, sums = (np.frombuffer(x, kind).tolist() for x, kind in zip(held, (U64, CHECK, np.int64), strict=True))
        out.setdefault(length, {}).update(zip(zip(keys, checks, strict=True), sums, strict=True))
    return out


class Phrases:
    """Phrases of one length and their bitmaps: entry k of phrase `of[k]` has `bits[k]` in chunk `chunk[k]`."""

    def __init__(self, words: np.ndarray, keys: np.ndarray, of: np.ndarray, chunk: np.ndarray, bits: np.ndarray):
        self.words, self.keys, self.of, self.chunk, self.bits = words, keys, of, chunk, bits
        self.first = np.searchsorted(of, np.arange(len(keys) + 1))

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, np.bitwise_count(self.bits), len(self.keys)).astype(np.int64)

    def kept(self, which: np.ndarray) -> Phrases:
        inside = which[self.of]
        return Phrases(self.words[which], self.keys[which], (np.cumsum(which) - 1)[self.of[inside]], self.chunk[inside], self.bits[inside])

    def blocks(self, most: int) -> Iterator[Phrases]:
        """Runs of phrases of about `most` entries."""
        at = 0
        while at < len(self.keys):
            end = max(at + 1, int(np.searchsorted(self.first, self.first[at] + most, "right")) - 1)
            a, b = self.first[at], self.first[end]
            yield Phrases(self.words[at:end], self.keys[at:end], self.of[a:b] - at, self.chunk[a:b], self.bits[a:b])
            at = end


class Shard:
    """The bitmaps of a shard's frequent words, by chunk, and how phrases grow by them."""

    def __init__(self, row: dict):
        self.lang, self.spelt = row["lang"], row["words"].split(b" ")[:-1]
        self.hashes, self.second = _hashes(row["words"]), _hashes(row["words"], 1)
        self.word, self.chunk, self.bits = _unpacked(row["word"], np.int32), np.cumsum(_unpacked(row["chunk"], np.int32), dtype=np.int64), _unpacked(row["bits"], CHUNK)
        self.at = np.searchsorted(self.chunk, np.arange(self.chunk[-1] + 3 if len(self.chunk) else 2))
        self.seed = _seed(self.lang)

    def row(self, id_: int, spelt: bytes, use: np.ndarray) -> tuple:
        """The shard as a row again, with the positions of `use` alone (a mask for each chunk)."""
        bits = self.bits & use[self.chunk]
        at = np.flatnonzero(bits)
        return id_, self.lang, spelt, _packed(self.word[at]), _packed(np.diff(self.chunk[at], prepend=0).astype(np.int32)), _packed(bits[at])

    def paired(self, told: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The positions that belong to frequent pairs, a mask for each chunk."""
        ends = np.zeros(len(self.at) + 1, CHUNK)
        for part in self.single().blocks(block):
            pairs = self.grown(part)
            pairs = pairs.kept(_held(pairs.keys, told))
            np.bitwise_or.at(ends, pairs.chunk, pairs.bits)
        starts = (ends >> CHUNK(1)) | (np.append(ends[1:], CHUNK(0)) << CHUNK((1 << WIDTH) - 1))
        return ends | starts

    def single(self) -> Phrases:
        """The words themselves."""
        order = np.argsort(self.word, kind="stable")
        return Phrases(np.arange(len(self.spelt), dtype=np.int32)[:, None], _grown(self.seed, self.hashes), self.word[order].astype(np.int64), self.chunk[order], self.bits[order])

    def grown(self, held: Phrases) -> Phrases:
        """Every phrase that follows from one of `held` by a word: shift by a position, AND with the words of the chunk."""
        carry = held.bits >> CHUNK((1 << WIDTH) - 1)
        over = carry > 0
        of, chunk, bits = np.concatenate((held.of, held.of[over])), np.concatenate((held.chunk, held.chunk[over] + 1)), np.concatenate((held.bits << CHUNK(1), carry[over]))
        size = self.at[chunk + 1] - self.at[chunk]
        with_ = _span(self.at[chunk], size)
        both = np.repeat(bits, size) & self.bits[with_]
        met = np.flatnonzero(both)
        of, with_, both = np.repeat(of, size)[met], with_[met], both[met]
        pair = of * len(self.spelt) + self.word[with_]
        order = np.argsort(pair, kind="stable")
        pair, chunk, both = pair[order], self.chunk[with_[order]], both[order]
        first = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
        before, word = np.divmod(pair[first], len(self.spelt) or 1)
        return Phrases(np.column_stack((held.words[before], word.astype(np.int32))), _grown(held.keys[before], self.hashes[word]), np.cumsum(first) - 1, chunk, both)

    def without_first(self, words: np.ndarray) -> np.ndarray:
        """Fingerprints of the phrases without their first words."""
        keys = np.full(len(words), self.seed, U64)
        for column in words[:, 1:].T:
            keys = _grown(keys, self.hashes[column])
        return keys

    def checks(self, words: np.ndarray) -> np.ndarray:
        """The second parts of the fingerprints of phrases."""
        keys = np.full(len(words), self.seed, U64)
        for column in words.T:
            keys = _grown(keys, self.second[column])
        return keys.astype(CHECK)

    def walk(self, told: dict[int, np.ndarray], known: int, length: int, block: int = 1 << 16) -> Iterator[tuple[int, Phrases]]:
        """Phrases of up to `length` words, depth first; frequent by `told` up to `known` words, beyond that only their shorter parts."""
        none = np.zeros(0, U64)

        def below(held: Phrases, size: int):
            yield size, held
            if size < length:
                for part in held.blocks(block):
                    more = self.grown(part)
                    fine = _held(more.keys, told.get(size + 1, none)) if size < known else np.ones(len(more.keys), bool)
                    if size > 1:
                        fine &= _held(self.without_first(more.words), told.get(size, none))
                    yield from below(more.kept(fine), size + 1)

        yield from below(self.single(), 1)


def phrase_counts(docs: DataFrame, scratch: Scratch, min_count: int, longest: int, lang_col: str = "lang", text_col: str = "text", block: int = 16 << 20, part: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """Words a language (lang, n), and all phrases of up to `longest` words that occur `min_count` times in one (lang, length, phrase, a)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    shards = scratch.keep(texts.mapInArrow(_shards(block), _SHARD), "shards")
    totals = scratch.keep(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    parts = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // part))

    def words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, checks = (_grown(_seed(row["lang"]), _hashes(row["words"], k)) for k in (0, 1))
                yield from _send(row["id"], keys, checks, _unpacked(row["counts"], np.int32), parts).to_batches()

    def frequent(sent: DataFrame, length: int) -> DataFrame:
        return sent.groupBy("part").applyInArrow(_frequent(min_count, length), _TELL)

    def bitmaps(key, shard, found):
        out = []
        told = _told(found).get(1, np.zeros(0, U64))
        for row in shard.to_pylist() if len(told) else []:
            often = _held(_grown(_seed(row["lang"]), _hashes(row["words"])), told)
            spelt = row["words"].split(b" ")[:-1]
            number = np.concatenate(([-1], np.where(often, np.cumsum(often) - 1, -1)))
            tokens = number[_unpacked(row["tokens"], np.int32)]
            at = np.flatnonzero(tokens >= 0)
            pair = (at >> WIDTH) * len(spelt) + tokens[at]
            order = np.argsort(pair, kind="stable")
            pair, bit = pair[order], CHUNK(1) << (at[order] & ((1 << WIDTH) - 1)).astype(CHUNK)
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            chunk, word = np.divmod(pair[first], len(spelt))
            kept = b"".join(w + b" " for w, o in zip(spelt, often, strict=True) if o)
            out.append((row["id"], row["lang"], kept, _packed(word.astype(np.int32)), _packed(np.diff(chunk, prepend=0).astype(np.int32)), _packed(np.bitwise_or.reduceat(bit, first))))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(_BITMAPS.types)], schema=_BITMAPS)

    found = scratch.keep(frequent(shards.select("id", "lang", "words", "counts").mapInArrow(words, _SEND), 1), "frequent-1")
    scratch.sweep()
    held = shards.select("id", "lang", "words", "tokens").groupBy("id").cogroup(found.select("id", "length", "keys").groupBy("id")).applyInArrow(bitmaps, _BITMAP)
    held = scratch.keep(held, "bitmaps")
    scratch.drop("shards")
    scratch.sweep()

    def cells(row, told, length):
        got = [(p.keys >> U64(32), p.counts()) for size, p in Shard(row).walk(told, length - 1, length) if size == length]
        return _send_cells(row["id"], *(np.concatenate(x) for x in zip(*got, strict=True)), parts) if got else _CELLS.empty_table()

    def cells_of_pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from cells(row, {}, 2).to_batches()

    def cells_of(length):
        def send(key, shard, found):
            told = _told(found)
            return pa.concat_tables([_CELLS.empty_table(), *(cells(row, told, length) for row in shard.to_pylist())])

        return send

    def phrases(length):
        def send(key, shard, found):
            out = [pa.table([[]] * len(_SENT), schema=_SENT)]
            told = _told(found)
            full = told.get(0, np.zeros(0, U64))
            for row in shard.to_pylist():
                own, got = Shard(row), []
                for size, p in own.walk(told, length - 1, length):
                    if size == length:
                        at = _held(p.keys >> U64(32), full)
                        got.append((p.keys[at], own.checks(p.words[at]), p.counts()[at]))
                if got:
                    out.append(_send(row["id"], *(np.concatenate(x) for x in zip(*got, strict=True)), parts))
            return pa.concat_tables(out)

        return send

    def spell(key, shard, found):
        out = [pa.table([[], [], [], []], schema=_COUNTED)]
        told, sums = _told(found), _own(found)
        for row in shard.to_pylist():
            own = Shard(row)
            for size, p in own.walk(told, longest, longest):
                mine = sums.get(size, {})
                at = np.flatnonzero(_held(p.keys, np.sort(np.array([k for k, _ in mine], U64))))
                asked = [mine.get(k) for k in zip(p.keys[at].tolist(), own.checks(p.words[at]).tolist(), strict=True)]
                spelt = [(b" ".join([own.spelt[w] for w in ws]), a) for ws, a in zip(p.words[at].tolist(), asked, strict=True) if a is not None]
                out.append(pa.table([pa.array([own.lang] * len(spelt), pa.string()), pa.array([size] * len(spelt), pa.int32()), pa.array([w for w, _ in spelt], pa.binary()), pa.array([a for _, a in spelt], pa.int64())], schema=_COUNTED))
        return pa.concat_tables(out)

    def trim(key, shard, found):
        told = _told(found).get(2, np.zeros(0, U64))
        out = []
        for row in shard.to_pylist():
            own = Shard(row)
            out.append(own.row(row["id"], row["words"], own.paired(told)))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(_BITMAPS.types)], schema=_BITMAPS)

    for length in range(2, longest + 1):
        told = found.select("id", "length", "keys")
        # pairs are made of all frequent words, so nothing has to meet the shards
        sent = held.mapInArrow(cells_of_pairs, _CELL) if length == 2 else held.groupBy("id").cogroup(told.groupBy("id")).applyInArrow(cells_of(length), _CELL)
        full = scratch.keep(sent.groupBy("part").applyInArrow(_full(min_count), "id long, length int, keys binary"), f"full-{length}")
        scratch.sweep()
        sent = held.groupBy("id").cogroup(told.unionByName(full).groupBy("id")).applyInArrow(phrases(length), _SEND)
        found = found.unionByName(scratch.keep(frequent(sent, length), f"frequent-{length}"))
        scratch.drop(f"full-{length}")
        if length == 2:
            scratch.sweep()
            # what is in no frequent pair is in no longer phrase: later rounds carry the rest alone
            held = scratch.keep(held.groupBy("id").cogroup(found.select("id", "length", "keys").groupBy("id")).applyInArrow(trim, _BITMAP), "pairs")
            scratch.drop("bitmaps")
        scratch.sweep()
    counted = held.groupBy("id").cogroup(found.groupBy("id")).applyInArrow(spell, "lang string, length int, phrase binary, a long")
    return totals, scratch.keep(counted.select("lang", "length", F.col("phrase").cast("string").alias("phrase"), "a"), "counts")


def _exact(*factors: Column | str) -> Column:
    out = F.lit(1).cast("decimal(1,0)")
    for f in factors:
        out = out * (F.col(f) if isinstance(f, str) else f).cast("decimal(19,0)")
    return out.cast("decimal(38,0)")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, absorbed: int = 100, salts: int = 32, **options) -> DataFrame:
    """Per language the `top` phrases by score: lang, rank, phrase, a, l, r, n, score. A phrase goes if a longer one has `absorbed` percent of its count."""
    scratch = Scratch(docs.sparkSession, "collocations")
    totals, counts = phrase_counts(docs, scratch, min_count, longest, **options)
    spelt = counts.where("length > 1").withColumn("ws", F.split("phrase", " "))

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("ws", start, size), " ")

    cuts = spelt.select("lang", "phrase", "a", "length", "ws", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    left, right = (counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(side[0])) for side in ("left", "right"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumns({"_over": _exact(F.lit(1000), "a", "n"), "_under": _exact("l", "r")}).withColumn("score", F.expr("_over div _under"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")

    inner = spelt.where("length > 2").select("lang", F.col("a").alias("f"), "length", "ws", F.explode(F.expr("sequence(2, length - 1)")).alias("size"))
    inner = inner.select("lang", "f", "size", "ws", F.explode(F.expr("sequence(1, length - size + 1)")).alias("start"))
    longer = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("f"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (_exact(F.lit(100), "f") < _exact(F.lit(absorbed), "a"))).drop("f")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
