"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontamination import decontaminate
from .language_id import held_out, predict, train
from .line_dedup import dedup_lines
from .minhash_dedup import near_duplicates
from .mixing import mix, topic_of
from .nn_descent import nearest
from .piece_encoding import encode_pieces
from .sql import ORACLES
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_bytes
from .token_counts import count_tokens
from .url_filter import filter_urls
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", predict(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Its SQL fixes the first word as topic and probabilities cut off at 1; the pipeline does neither.
    mixed = mix(table(spark, sf_dir, "documents"), topic=topic_of(F.col("text")), clip=True)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", _sha256("kept_text").alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _sha256("kept_text").alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(table(spark, sf_dir, "documents"))
    ids = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256)
    # under ANSI rules element_at fails where a text has no pieces
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("starts", F.lit(1)), F.lit(0).cast("long"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"), covered.alias("n_bytes_covered"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's deviation is a long; one that is none is null
    return whiten(table(spark, sf_dir, "embeddings"), vanishing=True).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nn_descent": op1_nn_descent,
        "op2_language_id": op2_language_id,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_url_filter": op5_url_filter,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_piece_encoding": op11_piece_encoding,
        "op12_collocations": op12_collocations,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
