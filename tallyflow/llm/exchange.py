"""Find values that several document buckets share, by shuffling packed fingerprints.

Documents are dealt to buckets. Each bucket sends its distinct fingerprints, packed into one binary
value for each of `parts` ranges of the fingerprint, so a value that a third of the rows hold is one
entry a bucket. A range's task finds what occurs more than once and tells each bucket its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_partitions

SENT = "part long, bucket long, once binary, many binary"
FOUND = "bucket long, found binary"
_SENT = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("once", pa.binary()), ("many", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int64()), ("found", pa.binary())])


#: Bytes that a bucket holds at most, about: a task has one bucket at a time in memory.
BUCKET = 64 << 20


def bucket_count(docs: DataFrame, size: Column, times: int = 1, most: int = BUCKET) -> int:
    """How many buckets: `times` a shuffle partition, and more where these would hold over `most` bytes; `size` is a row's bytes."""
    whole = docs.agg(F.sum(F.coalesce(size, F.lit(0)).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession) * times, -(-whole // most))


def bucketed(docs: DataFrame, count: int, *columns: str) -> DataFrame:
    """`docs` with the number of one of `count` buckets, even when ids repeat or are null; whole rows each, so copies of one row share one."""
    return docs.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(count)))


def _order(keys: np.ndarray) -> np.ndarray:
    """Sort order of (n, width) fingerprints, first column first."""
    return np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])


def _groups(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: whether each differs from the one before."""
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return new


def unpack(blobs: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, width)


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which rows of `keys` are rows of `of`."""
    if not len(of) or not len(keys):
        return np.zeros(len(keys), bool)
    both = np.concatenate((of, keys))
    order = _order(both)
    group = np.cumsum(_groups(both[order])) - 1
    held = np.zeros(group[-1] + 1, bool)
    held[group[order < len(of)]] = True
    out = np.empty(len(both), bool)
    out[order] = held[group]
    return out[len(of) :]


def send(keys: np.ndarray, bucket: int, parts: int) -> pa.Table:
    """A row for each range with this bucket's distinct fingerprints: those seen once here, and more often."""
    keys = keys[_order(keys)]
    at = np.flatnonzero(_groups(keys))
    count = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    part = ((keys[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    pick = [(keys[a:b], count[a:b] == 1) for a, b in zip(cut[full], cut[full + 1], strict=True)]
    return pa.table(
        [full, np.full(len(full), bucket), pa.array([k[s].tobytes() for k, s in pick], pa.binary()), pa.array([k[~s].tobytes() for k, s in pick], pa.binary())],
        schema=_SENT,
    )


def _repeats(width: int) -> Callable[[pa.Table], pa.Table]:
    def find(table: pa.Table) -> pa.Table:
        own = [unpack([a, b], width) for a, b in zip(table["once"].to_pylist(), table["many"].to_pylist(), strict=True)]
        every = np.concatenate(own)
        every = every[_order(every)]
        new = _groups(every)
        at = np.flatnonzero(new)
        often = every[at[np.diff(np.append(at, len(every))) > 1]]
        often = np.concatenate((often, unpack(table["many"].to_pylist(), width)))
        ids, found = [], []
        bound = np.cumsum([len(x) for x in own])
        hit = member(np.concatenate(own), often)
        for b, x, end in zip(table["bucket"].to_pylist(), own, bound, strict=True):
            if (h := hit[end - len(x) : end]).any():
                ids.append(b)
                found.append(x[h].tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], schema=_FOUND)

    return find


def repeated(sent: DataFrame, width: int) -> DataFrame:
    """For each bucket, those of its fingerprints that occur at least twice in all buckets together."""
    return sent.groupBy("part").applyInArrow(_repeats(width), FOUND)


def rows(table: pa.Table, column: str) -> Iterator[bytes]:
    return (x for x in table[column].to_pylist() if x is not None)
