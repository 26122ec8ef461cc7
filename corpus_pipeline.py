"""The corpus pipeline: each stage calls one training-data operator and lets its decisions take effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and reads it again
as the next stage's documents. All stages but the last return the columns of `documents`.

Defined results: a table without rows passes all stages; near-dedup keeps one row of a group of near copies,
with or without doc_id; columns beside those of `documents` pass through the stages, whatever their names. The
last stage adds topic, n_tokens, weight and probability; one whose name is taken is called mix_ and that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.decontamination import decontaminate
from tallyflow.llm.identity import LAST, document, free_prefix
from tallyflow.llm.language_id import UNKNOWN, held_out, predict, train
from tallyflow.llm.line_dedup import dedup_lines
from tallyflow.llm.minhash_dedup import one_of_each
from tallyflow.llm.mixing import mix
from tallyflow.llm.scratch import Scratch

#: A language is sure from this posterior on.
SURE = 0.5


#: What `dedup_lines` adds.
LINE_RESULTS = ("n_lines", "n_removed", "n_runs", "kept_text")


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns of those names, in any case of letters, under names that are free, and what each is called."""
    prefix = free_prefix(docs.columns, "_aside_")
    back = {c: prefix + c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(back), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language that is sure. Learns from the labelled rows that are not held out."""
    model = train(docs.where(~held_out()))
    own = free_prefix(docs.columns, "_said")
    said = docs.withColumn(own, predict(docs, model))
    return said.where((F.col(f"{own}.lang_pred") != UNKNOWN) & (F.col(f"{own}.score") >= SURE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces texts by what is left of them; a document of which nothing is left goes."""
    away, back = _aside(docs, LINE_RESULTS)
    found = dedup_lines(away)
    left = found.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return left.select(*({"text": text.alias("text"), "n_chars": size.alias("n_chars")}.get(c, F.col(back.get(c, c)).alias(c)) for c in docs.columns))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest doc_id, the first without ids."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lets documents with benchmark passages go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text_hash").distinct()
    prefix = free_prefix(docs.columns, "_bad_")
    own = dict(zip((f"{prefix}ord", f"{prefix}hash"), document(F.col("doc_id"), F.col("text")), strict=True))
    return docs.withColumns(own).join(bad.toDF(*own), list(own), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples the documents to the target weights."""
    _, back = _aside(docs, ("topic", "n_tokens", "weight", "probability", "kept"))
    mixed = mix(docs.withColumns({new: F.col(c) for c, new in back.items()})).where("kept")
    results = {"topic": F.col("topic"), "n_tokens": F.col("n_tokens"), "weight": F.round("weight", 6), "probability": F.round("probability", 6)}
    taken = {c.lower() for c in docs.columns}
    named = [c.alias(f"mix_{n}" if n in taken else n) for n, c in results.items()]
    return mixed.select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns), *named)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the language model, the line suffix array or the near-duplicate groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
