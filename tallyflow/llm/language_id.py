"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts by language and hash slot in Spark; the resulting log-probability matrix
(languages x slots, bounded by two parameters) is broadcast, and texts are scored in numpy batches.

A text is lower-cased; letters stay, every run of other characters becomes one word edge, and the text
begins and ends with an edge. Defined results: a null text or one without a letter is `und` with score 0,
as is every text when nothing was learned; ties go to the smallest language name; repeated rows are learned
from and judged once each; whole texts of any length are used; columns other than text and language are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import pieces

UNKNOWN = "und"
ORDERS = (2, 3)
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x slots


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(texts: list[str | None], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash slot and document of every n-gram, in document order, and whether a document has a letter."""
    edge = b"\0\0\0\0"
    held = [edge + (t or "").lower().encode("utf-32-le", "surrogatepass") + edge for t in texts]
    points = np.frombuffer(b"".join(held), np.uint32)
    size = np.array([len(x) // 4 for x in held])
    doc = np.repeat(np.arange(len(held)), size)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum(size) - size] = True
    with_letter = np.zeros(len(held), bool)
    with_letter[doc[letter]] = True
    points, doc = np.where(letter, points, 0)[keep].astype(np.uint32), doc[keep]
    slot, of = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x27D4EB2F, np.uint32)
        for k in range(n):
            h = (h ^ (points[k : k + m] * _K[k])) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        whole = doc[:m] == doc[n - 1 :]
        slot.append((h >> np.uint32(12)).astype(np.int64)[whole] % slots)
        of.append(doc[:m][whole])
    if not slot:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), with_letter
    slot, of = np.concatenate(slot), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return slot[order], of[order], with_letter


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = 1 << 16, alpha: float = 0.1, max_languages: int = 1000) -> Model:
    """Learn from every row with a language and a text. More than `max_languages` names is an error, as it bounds the broadcast."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                names, of_name = np.unique(np.array(piece["lang"].to_pylist(), object), return_inverse=True)
                slot, of, _ = _grams(piece["text"].to_pylist(), slots)
                for k, name in enumerate(names):
                    mine = sums.setdefault(name, np.zeros(slots + 1, np.int64))
                    mine[:slots] += np.bincount(slot[of_name[of] == k], minlength=slots)
                    mine[slots] += (of_name == k).sum()
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["lang", "slot", "n"])

    def as_row(key, table):
        counts = np.zeros(slots + 1, np.int64)
        counts[table["slot"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    summed = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").applyInArrow(as_row, "lang string, counts binary").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in found]).reshape(len(found), slots + 1)
    grams = counts[:, :slots] + alpha
    return Model(tuple(r["lang"] for r in found), np.log(np.maximum(counts[:, slots], 1) / max(1, counts[:, slots].sum())), np.log(grams / grams.sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column struct<lang_pred string, score double> over the texts of `docs`; score is the posterior of lang_pred."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(column: pa.Array) -> pa.Array:
        m = held.value
        names, scores = [], []
        for piece in pieces(pa.table({"text": column}), "text", 1 << 20):
            texts = piece["text"].to_pylist()
            slot, of, letters = _grams(texts, m.log_prob.shape[1] if len(m.languages) else 1)
            if not len(m.languages):
                letters[:] = False
            docs_at = np.flatnonzero(letters)
            name, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if len(docs_at):
                inside = letters[of]
                slot, begin = slot[inside], np.searchsorted(of[inside], docs_at)
                total = np.stack([np.add.reduceat(row[slot], begin) for row in m.log_prob], axis=1) + m.log_prior
                top = total.argmax(axis=1)
                name[docs_at] = np.array(m.languages, object)[top]
                best[docs_at] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names += name.tolist()
            scores.append(best)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(score, "lang_pred string, score double")(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Every third document by checksum of its id is kept out of training; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
