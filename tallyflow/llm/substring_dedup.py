"""Substring dedup: windows of words that start more than once, found through difference-cover anchors.

For a difference cover D modulo p, two equal windows of `window` words at positions i and j share a
shift d < p at which both i + d and j + d are cover positions. So fingerprints of the shorter window of
window - p + 1 words, taken at cover positions only (5 of 21), meet at every long match. Each repeated
anchor is then extended to all full windows that contain it, and those are compared by 128 bits.
Extending a class of equal anchors at once, instead of each pair of its members, keeps the work linear
however many copies there are.

Defined results: a null or empty text has no words; a text shorter than the window loses nothing; every
row is a document of its own, also with a repeated or null id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .textkit import WHITESPACE, Words, covered, pieces, text_bytes, windows

#: Perfect difference covers by period; every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}

RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest known period that leaves anchors of more than half a window, else single words."""
    fit = [p for p in COVERS if p <= window // 2 + 1]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _anchors(w: Words, window: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at cover positions and the fingerprints of the anchors there."""
    period, cover = cover_for(window)
    at = w.window_starts(window - period + 1)
    residue = (at - np.repeat(w.first[:-1], w.counts)[at]) % period
    at = at[np.isin(residue, cover)]
    return at, windows(hashes, at, window - period + 1)


def _candidates(w: Words, window: int, hashes: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Starts of full windows that hold a repeated anchor in their first `period` words."""
    period, _ = cover_for(window)
    at, keys = _anchors(w, window, hashes)
    at = at[exchange.member(keys[:, None], repeated)]
    begin = np.maximum(at - (period - 1), np.repeat(w.first[:-1], w.counts)[at])
    near = covered(begin, at - begin + 1, len(w.starts))
    full = w.window_starts(window)
    return full[near[full]]


def _pairs(hashes: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int) -> np.ndarray:
    return np.stack([windows(h, at, window, k) for k, h in enumerate(hashes)], axis=1)


def join_words(w: Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by single spaces."""
    kept = np.flatnonzero(keep)
    bound = np.searchsorted(kept, w.first)
    size = (w.ends - w.starts)[kept] + 1
    last = bound[1:][np.diff(bound) > 0] - 1
    size[last] -= 1
    end = np.concatenate(([0], np.cumsum(size)))
    out = np.full(end[-1], 0x20, np.uint8)
    length = (w.ends - w.starts)[kept]
    to = np.arange(length.sum()) + np.repeat(end[:-1] - (np.cumsum(length) - length), length)
    out[to] = w.data[to + np.repeat(w.starts[kept] - end[:-1], length)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bound) - 1, [None, pa.py_buffer(end[bound].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary()).cast(pa.string())


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", most: int = exchange.BUCKET) -> DataFrame:
    """Per document: n_words, n_removed, kept_text without the words of any window that starts elsewhere too. A bucket has about `most` bytes of text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = exchange.bucket_count(base, F.octet_length("text") + 64, most=most)
    base = exchange.bucketed(base, parts, "doc_id", "text")

    def anchors(key, table):
        found = [np.zeros(0, np.uint64)]
        for piece in pieces(table, "text"):
            w = Words(*text_bytes(piece["text"]), WHITESPACE)
            found.append(_anchors(w, window, w.hashes())[1])
        return exchange.send(np.concatenate(found)[:, None], key[0].as_py(), parts)

    def full_windows(key, table, repeated):
        often = exchange.unpack(exchange.rows(repeated, "found"), 1)
        found = [np.zeros((0, 2), np.uint64)]
        for piece in pieces(table, "text") if len(often) else ():
            w = Words(*text_bytes(piece["text"]), WHITESPACE)
            hashes = w.hashes(0)
            if len(at := _candidates(w, window, hashes, often)):
                found.append(_pairs((hashes, w.hashes(1)), at, window))
        return exchange.send(np.concatenate(found), key[0].as_py() if key[0] is not None else 0, parts)

    def remove(key, table, repeated):
        often = exchange.unpack(exchange.rows(repeated, "found"), 2)
        first = np.sort(often[:, 0])
        out = [_RESULT.empty_table()]
        for piece in pieces(table, "text"):
            w = Words(*text_bytes(piece["text"]), WHITESPACE)
            keep = np.ones(len(w.starts), bool)
            at = w.window_starts(window) if len(often) else np.zeros(0, np.int64)
            if len(at):
                h = w.hashes(0)
                one = windows(h, at, window)
                at = at[first[np.minimum(np.searchsorted(first, one), len(first) - 1)] == one]
            if len(at):
                at = at[exchange.member(_pairs((h, w.hashes(1)), at, window), often)]
                keep = ~covered(at, window, len(w.starts))
            left = np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
            out.append(pa.table([piece["doc_id"], w.counts, w.counts - left, join_words(w, keep)], schema=_RESULT))
        return pa.concat_tables(out)

    by_bucket = base.groupBy("bucket")
    anchor = exchange.repeated(by_bucket.applyInArrow(anchors, exchange.SENT), 1)
    full = exchange.repeated(by_bucket.cogroup(anchor.groupBy("bucket")).applyInArrow(full_windows, exchange.SENT), 2)
    return by_bucket.cogroup(full.groupBy("bucket")).applyInArrow(remove, RESULT)
