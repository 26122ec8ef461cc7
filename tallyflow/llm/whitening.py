"""Embedding whitening: leading principal axes by matrix-free block Lanczos, no covariance matrix is ever formed.

Entries become long integers x = floor(scale * c) + shift. One pass over the table gives n and the exact sums
S. Each further pass multiplies the covariance with a block of vectors, X'(XQ) over batches centred by
(n x - S) / n; what a task returns is one row a dimension, added up by Spark. The blocks are orthogonalised
against the whole basis, twice. Ritz pairs converge when the residual |Vu - eu| is below `tolerance` times the
largest eigenvalue, or when the basis spans the space; a block is as wide as the components asked for at least, so
equal eigenvalues are all found. A block that breaks down (the space is invariant so far) restarts with random
directions; a basis that grows over `most` columns restarts from its leading Ritz vectors and their residuals.
The trace is the sum of deviations, sum (n x - S)^2 / n^3, from the first centred pass.

The driver holds the basis and its image, `most` columns of a vector's length each, and sends a block a pass.

Defined results: rows whose vector is null, holds a null or non-finite entry or one whose x is no 64-bit integer, or
has another length than most rows (of equally many, the shorter), take no part; other rows are whitened, those
without id and repeated ones each for itself. Components whose eigenvalue vanishes beside the largest (equal
rows, fewer rows than components) have no whitened form and are left out, or with `vanishing` returned with a null
one, their share 0 (null where all vanish); identity_error is that of the others, null without any. An empty table
gives no rows. A deviation of more than 38 digits is null.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_RESULT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_PARTIAL = "at int, held array<double>"
#: x and what is computed of it exactly stay below this, or Python's own integers are used.
_SAFE = 1 << 62


def _usable(vector: Column, scale: int, shift: int) -> Column:
    # of doubles as large as these bounds only multiples of 1024 exist
    low = -float(((1 << 63) + min(0, shift)) >> 10 << 10)
    high = float(((1 << 63) - 1 - max(0, shift)) >> 10 << 10)
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (c * scale).between(low, high)), F.lit(False))


def _integers(batch: pa.RecordBatch, size: int, scale: int, shift: int) -> np.ndarray:
    flat = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
    return np.floor(flat * float(scale)).astype(np.int64) + shift


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: 64-bit integers where they are wide enough, Python's where not."""
    if not x.size or n * int(np.abs(x).max()) < _SAFE // 2 and max(map(abs, total)) < _SAFE // 2:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def _squares(centred: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exactly."""
    most = int(np.abs(centred).max()) if centred.size else 0
    if centred.dtype != object and most * most * max(1, centred.shape[1]) < _SAFE:
        return (centred * centred).sum(axis=1)
    wide = centred.astype(object)
    return (wide * wide).sum(axis=1)


class Vectors:
    """The rows that take part, and passes over them."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int):
        held = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        held = held.where(_usable(F.col("vector"), scale, shift))
        sizes = held.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").head(1)
        self.size, self.n = (sizes[0]["size"], sizes[0]["count"]) if sizes else (0, 0)
        self.rows = held.where(F.size("vector") == self.size)
        self.scale, self.shift = scale, shift
        self.total = self._total() if self.size else []

    def _total(self) -> list[int]:
        """The exact sum of each dimension; a batch's sum is cut in two so that neither half overflows."""
        size, scale, shift = self.size, self.scale, self.shift

        def add(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _integers(batch, size, scale, shift)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array((x >> 31).sum(axis=0)), pa.array((x & ((1 << 31) - 1)).sum(axis=0))], names=["at", "high", "low"])

        found = self.rows.mapInArrow(add, "at int, high long, low long").groupBy("at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
        parts = {r["at"]: (int(r["high"]) << 31) + int(r["low"]) for r in found.collect()}
        return [parts[k] for k in range(size)]

    def reduced(self, part: Callable[[np.ndarray], np.ndarray], height: int) -> np.ndarray:
        """Sum over batches of part(n x - S), a matrix of `height` rows; a task sends each row once."""
        n, total, size, scale, shift = self.n, self.total, self.size, self.scale, self.shift

        def add(batches):
            held = None
            for batch in batches:
                if batch.num_rows:
                    mine = part(_centred(_integers(batch, size, scale, shift), n, total))
                    held = mine if held is None else held + mine
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.array(list(held), pa.list_(pa.float64()))], names=["at", "held"])

        sent = self.rows.mapInArrow(add, _PARTIAL).select("at", F.posexplode("held").alias("col", "v"))
        cells = sent.groupBy("at", "col").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((height, max(c["col"] for c in cells) + 1))
        for c in cells:
            out[c["at"], c["col"]] = c["v"]
        return out


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Columns orthonormal to the basis and each other; where the block has lost rank, random directions take the place of columns."""
    width = min(block.shape[1], block.shape[0] - basis.shape[1])
    out, k = np.zeros((block.shape[0], 0)), 0
    while out.shape[1] < width:
        v = block[:, k] if k < block.shape[1] else rng.standard_normal(block.shape[0])
        k += 1
        size = np.linalg.norm(v)
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            v = v / left
            v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
            out = np.column_stack((out, v / np.linalg.norm(v)))
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], size: int, k: int, block: int, tolerance: float, most: int, passes: int = 500, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric operator, their unit vectors, and the passes taken."""
    rng = np.random.default_rng(seed)
    k, block = min(k, size), max(block, k)
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    new = _orthonormal(rng.standard_normal((size, min(block, size))), basis, rng)
    for taken in range(1, passes + 1):
        basis, image = np.column_stack((basis, new)), np.column_stack((image, apply(new)))
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :k]
        if basis.shape[1] == size:
            return values[:k], ritz / np.linalg.norm(ritz, axis=0), taken
        residual = image @ turn[:, :k] - ritz * values[:k]
        if (np.linalg.norm(residual, axis=0) <= tolerance * max(values[0], 0)).all():
            return values[:k], ritz / np.linalg.norm(ritz, axis=0), taken
        new = image[:, -new.shape[1] :]
        if basis.shape[1] + block > most:
            # the leading Ritz vectors stay; the residuals of the k wanted and random directions go on from them
            keep = max(k + block, most // 2)
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
            new = np.column_stack((residual, rng.standard_normal((size, block - k))))
        new = _orthonormal(new, basis, rng)
    raise ValueError(f"residuals above {tolerance} after {passes} passes")


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100000, block: int = 16, tolerance: float = 1e-12, most: int = 256, vanishing: bool = False) -> DataFrame:
    """Per row and component: n, exact deviation, whitened value, explained share, and the largest error of the whitened covariance. With `vanishing`, components of no variance too."""
    held = Vectors(vectors, id_col, vector_col, scale, shift)
    n, size, total = held.n, held.size, held.total
    empty = vectors.sparkSession.createDataFrame([], RESULT)
    if not n or not size:
        return empty
    context = vectors.sparkSession.sparkContext
    spread = held.reduced(lambda c: np.array([[float(_squares(c).sum())]]), 1)[0, 0] / n**2
    if spread <= 0 and not vanishing:
        return empty

    def apply(q: np.ndarray) -> np.ndarray:
        sent = context.broadcast(q)

        def part(centred):
            c = centred.astype(np.float64) / n
            return c.T @ (c @ sent.value)

        return held.reduced(part, size) / n

    values, axes, error = np.zeros(min(components, size)), np.zeros((size, min(components, size))), None
    if spread > 0:
        values, axes, _ = lanczos(apply, size, components, block, tolerance, max(most, 2 * block + components))
    real = values > values[:1] * size * 1e-14
    count = len(real) if vanishing else int(real.sum())
    values, axes = values[real], axes[:, real]
    scaled = context.broadcast(axes / np.sqrt(values))

    def gram(centred):
        w = (centred.astype(np.float64) / n) @ scaled.value
        return np.vstack((w.T @ w, w.sum(axis=0)))

    if len(values):
        found = held.reduced(gram, len(values) + 1)
        mean = found[-1] / n
        error = float(np.abs(found[:-1] / n - np.outer(mean, mean) - np.eye(len(values))).max())
    shares = [float(v) for v in values / (spread / n)] + [0.0 if spread > 0 else None] * (count - len(values))
    shift_, scale_ = shift, scale

    def project(batches):
        k = len(shares)
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(_integers(batch, size, scale_, shift_), n, total)
            w = np.full((batch.num_rows, k), np.nan)
            w[:, : scaled.value.shape[1]] = (centred.astype(np.float64) / n) @ scaled.value
            far = _squares(centred)
            far = pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype != object else pa.array([Decimal(int(v)) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            rows = np.repeat(np.arange(batch.num_rows), k)
            columns = [batch["vec_id"].take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(rows), n)), far.take(pa.array(rows)), pa.array(w.reshape(-1), from_pandas=True), pa.array(shares * batch.num_rows, pa.float64()), pa.array([error] * len(rows), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_RESULT)

    return held.rows.mapInArrow(project, RESULT)
