"""Token counts by section: whole documents are encoded once, and token spans are joined to section spans.

A byte-level vocabulary covers every byte of a text once, so token byte spans are running sums of token
lengths. Sections are the lines of a text, each with its line end. A token that crosses a boundary goes to
the section of its first byte ("start"), its last byte ("end"), or where most of its bytes lie, the earlier
on a tie ("most"). Every token is counted in exactly one section.

Defined results: an empty or null text is one empty section 0 with no tokens; rows are counted one by one,
so repeated or null ids stay apart as rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import pieces, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = "doc_id long, section int, start_byte long, end_byte long, n_tokens long, n_crossing long"
_RESULT = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
_made: dict[int, tuple] = {}


def _encoding(held: bytes):
    import tiktoken

    key = hash(held)
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held.splitlines() if line)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _made[key]


def section_tokens(data: np.ndarray, offsets: np.ndarray, size: np.ndarray, rule: str) -> tuple[np.ndarray, ...]:
    """Document, number, start, end, tokens and crossing tokens of each section; `size` are the token lengths in order."""
    doc_start = offsets[:-1]
    line = np.flatnonzero(data == 0x0A) + 1
    starts = np.unique(np.concatenate((doc_start[np.diff(offsets) > 0], line[line < len(data)])))
    ends = np.append(starts[1:], len(data))[: len(starts)]
    end = np.cumsum(size)
    begin = end - size
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    at = first
    if rule == "end":
        at = last
    elif rule == "most":
        at = first.copy()
        for k in np.flatnonzero(first < last):
            cut = np.concatenate(([begin[k]], starts[first[k] + 1 : last[k] + 1], [end[k]]))
            at[k] = first[k] + np.diff(cut).argmax()
    tokens = np.bincount(at, minlength=len(starts))
    crossing = np.bincount(at[first < last], minlength=len(starts))
    doc = np.searchsorted(offsets, starts, "right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    first_of_doc = np.searchsorted(doc, doc)
    number = np.arange(len(starts)) - first_of_doc
    zero = np.zeros(len(empty), np.int64)
    return tuple(np.concatenate(x) for x in ((doc, empty), (number, zero), (starts - doc_start[doc], zero), (ends - doc_start[doc], zero), (tokens, zero), (crossing, zero)))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and section: byte span, n_tokens by `rule`, and how many of those cross a boundary."""
    if rule not in ("start", "end", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    with open(os.path.expanduser(vocabulary), "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        encoding, length = _encoding(held.value)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                ids = [np.asarray(encoding.encode_ordinary(t), np.int64) for t in piece["text"].to_pylist() if t]
                size = length[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
                doc, *rest = section_tokens(*text_bytes(piece["text"]), size, rule)
                yield pa.RecordBatch.from_arrays([piece["doc_id"].take(pa.array(doc)), *(pa.array(x, t) for x, t in zip(rest, _RESULT.types[1:], strict=True))], schema=_RESULT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, RESULT)
