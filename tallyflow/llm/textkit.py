"""Vectorised words and fingerprints over batches of UTF-8 text.

A batch is one byte array with document offsets. A word's fingerprint is a sum over its eight-byte chunks,
each scrambled together with its place, so words of any length take one pass and no two patterns of bytes
cancel out. Windows of words are polynomials modulo 2^64 in these fingerprints over prefix sums, so that any
window costs O(1) once the batch is summed; such a sum can only cancel by its form over a thousand words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd numbers, (chunk places, window multiplier), for each of the two independent hash families.
_BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: The first k bytes of eight, for k = 0 to 8.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k for k < n, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        have = _powers[base] = (tables[0], tables[1])
    return have


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _pow(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _spans(sums: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * _pow(base, len(sums))[1][starts]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, at, held = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(table: pa.Table | pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.Table | pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text, whole rows each."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(table[column].cast(pa.large_binary())), 0)).astype(np.int64) + 1)
    at = 0
    while at < table.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield table.slice(at, end - at)
        at = end


class Words:
    """Words of a batch: byte spans `starts`, `ends`; document d has words first[d]:first[d+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        n = len(data)
        self.data = data
        inside = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        place = U64(_BASES[family][0])
        size = self.ends - self.starts
        if not len(size):
            return np.zeros(0, U64)
        chunks = (size + 7) >> 3
        first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        k = np.arange(chunks.sum()) - np.repeat(first, chunks)
        # eight bytes from every chunk's start, those beyond the word masked out
        eights = np.ndarray(len(self.data), "<u8", np.concatenate((self.data, np.zeros(8, np.uint8))), strides=(1,))
        held = eights[np.repeat(self.starts, chunks) + (k << 3)] & _MASKS[np.minimum(np.repeat(size, chunks) - (k << 3), 8)]
        return mix(np.add.reduceat(mix(mix(held) + (k + 1).astype(U64) * place), first) + size.astype(U64))

    def window_starts(self, size: int) -> np.ndarray:
        """Indexes of the words at which a window of `size` words of one document starts."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= size)


def windows(values: np.ndarray, at: np.ndarray, size: int | np.ndarray, family: int = 0) -> np.ndarray:
    """Fingerprint of `size` consecutive values from each index of `at`."""
    base = _BASES[family][1]
    return mix(_spans(_sums(values, base), base, at, at + size))


def covered(at: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Mask over n items of those within [a, a + size) for any a."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0
