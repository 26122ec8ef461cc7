"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling.

Every line becomes a number, the rank of its fingerprint among all distinct lines. A round of doubling
ranks the suffixes by their first 2h lines from the pairs (rank of h lines here, rank of h lines h further
on); a pair is ranked by a range-partitioned sort of the distinct pairs and the counts of the partitions
before. An interval of suffixes that share `min_lines` lines is then a class of equal ranks, and all
members but the first in (doc_id, line) order are later copies. Ranks to depth `min_lines` decide every
deletion, so doubling stops there; longer repeated runs are unions of such classes' lines.

A run counts if it has `min_lines` lines, or is one line of at least `min_chars` characters.

Defined results: a null text has no lines; an empty text has one empty line; rows equal in id and text are
one document, and share its decisions; a null doc_id comes last in the order; other columns are kept,
but for columns named n_lines, n_removed, n_runs or kept_text, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .identity import DOCUMENT as _DOC
from .identity import document, free_prefix
from .scratch import Scratch


def _tied(rows: DataFrame, keys: tuple[str, str], scratch: Scratch, name: str) -> DataFrame:
    """Rows whose key pair occurs more than once, with `rank`, the pair's place in the order of all such pairs, and `first`, its first position."""
    a, b = keys
    at = F.struct(*_DOC, "pos")
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    placed = scratch.keep(pairs.repartitionByRange("a", "b").withColumn("pid", F.spark_partition_id()), name)
    starts, before = [], 0
    for r in sorted(placed.groupBy("pid").count().collect()):  # one row a partition
        starts.append((r["pid"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "pid int, before long")
    local = F.row_number().over(Window.partitionBy("pid").orderBy("a", "b"))
    ranks = placed.join(F.broadcast(starts), "pid").select(F.col("a").alias(a), F.col("b").alias(b), (F.col("before") + local - 1).alias("rank"), "first")
    return rows.join(ranks, [a, b]).drop(a, b)


def repeated_runs(lines: DataFrame, depth: int, scratch: Scratch) -> dict[int, DataFrame]:
    """Suffixes tied on their first h lines, for h = 1, 2, 4, ... and at last `depth`: document, pos, rank, first.

    `lines` has the document columns, pos and the line's fingerprint id1, id2. A suffix alone with its
    first h lines is in its final place and repeats nothing longer, so it leaves the doubling.
    """
    level = scratch.keep(_tied(lines, ("id1", "id2"), scratch, "ids"), "tied1")
    out, h = {1: level}, 1
    while h < depth:
        step = min(h, depth - h)
        ahead = level.select(*_DOC, (F.col("pos") - step).alias("pos"), F.col("rank").alias("rank2"))
        pairs = level.select(*_DOC, "pos", F.col("rank").alias("rank1")).join(ahead, [*_DOC, "pos"])
        h += step
        level = scratch.keep(_tied(scratch.keep(pairs, f"pairs{h}"), ("rank1", "rank2"), scratch, f"ids{h}"), f"tied{h}")
        out[h] = level
    return out


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_chars: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_lines, n_removed, n_runs and kept_text, the text without later copies of repeated lines."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    line = F.col("line")
    lines = docs.select(*document(F.col(id_col), F.col(text_col)), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")).select(
        *_DOC, "pos", F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(7), line).alias("id2"), (F.length(line) >= min_chars).alias("long")
    )
    levels = repeated_runs(lines, min_lines, scratch)
    later = F.struct(*_DOC, "pos") > F.col("first")
    single = levels[1].where(F.col("long") & later).select(*_DOC, "pos")
    run = levels[min_lines].where(later).select(*_DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("pos"))
    removed = single.unionByName(run).groupBy(*_DOC).agg(F.collect_set("pos").alias("gone"))
    own = free_prefix(docs.columns, "_lines_")
    names = [own + c for c in _DOC]
    out = docs.withColumns(dict(zip(names, document(F.col(id_col), F.col(text_col)), strict=True)))
    out = out.join(removed.select(*(F.col(c).alias(n) for c, n in zip(_DOC, names, strict=True)), F.array_sort("gone").alias(own + "gone")), names, "left")
    gone = F.coalesce(own + "gone", F.array().cast("array<int>"))
    held = F.split(F.col(text_col), "\n", -1)
    # gone is sorted, so the first line of a removed run is one whose predecessor is not removed
    starts = F.size(F.array_except(gone, F.transform(gone, lambda p: p + 1)))
    pieces = F.filter(
        F.transform(F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size(held))).alias("b")), lambda r: F.slice(held, r["a"] + 2, F.greatest(r["b"] - r["a"] - 1, F.lit(0)))),
        lambda x: F.size(x) > 0,
    )
    kept = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return out.withColumns(
        {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(held)).cast("long"), "n_removed": F.size(gone).cast("long"), "n_runs": starts.cast("long"), "kept_text": kept}
    ).drop(*names, own + "gone")
