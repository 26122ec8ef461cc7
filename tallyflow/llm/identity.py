"""What tells documents apart where ids repeat or are missing: the id and a hash of the text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT = ["ord", "text_hash"]
#: What stands for a missing id, so that it comes last.
LAST = (1 << 63) - 1


def document(doc_id: Column, text: Column) -> list[Column]:
    """ord and text_hash. In their order documents follow by id, those without id last; the hash's sign says whether there is an id."""
    doc_id, digest = doc_id.cast("long"), F.xxhash64(text)
    signed = F.when(doc_id.isNull(), digest.bitwiseAND(F.lit(LAST))).otherwise(digest.bitwiseOR(F.lit(-LAST - 1)))
    return [F.coalesce(doc_id, F.lit(LAST)).alias("ord"), signed.alias("text_hash")]


def doc_id() -> Column:
    """The id that `document` was given, from ord and text_hash."""
    return F.when(F.col("text_hash") < 0, F.col("ord"))


def free_prefix(columns: Iterable[str], wish: str) -> str:
    """A prefix that no column starts with, in any case of letters."""
    while any(c.lower().startswith(wish) for c in columns):
        wish += "_"
    return wish
