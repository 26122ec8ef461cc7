"""Rate cards from published catalogues: one price a model, or the best of several providers' listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rate_card import FAST, SCHEMA

# The provider that makes models whose name begins so.
OFFICIAL = {
    "glm": "zai", "gpt": "openai", "o1": "openai", "o3": "openai", "o4": "openai", "codex": "openai", "claude": "anthropic", "gemini": "google", "gemma": "google", "nano-banana": "google", "veo": "google", "imagen": "google", "grok": "xai", "deepseek": "deepseek",
    "qwen": "alibaba", "qwq": "alibaba", "qvq": "alibaba", "kimi": "moonshotai", "k2": "moonshotai", "minimax": "minimax", "mistral": "mistral", "magistral": "mistral", "devstral": "mistral", "ministral": "mistral", "pixtral": "mistral", "codestral": "mistral", "command": "cohere", "doubao": "volcengine",
}
_FIELDS = [f.split() for f in SCHEMA.split(", ")]


def official_provider(model: Column) -> Column:
    """By the longest prefix that fits."""
    by_length = sorted(OFFICIAL.items(), key=lambda x: len(x[0]))
    return reduce(lambda out, x: F.when(F.startswith(F.lower(model), F.lit(x[0])), F.lit(x[1])).otherwise(out), by_length, F.lit(None).cast("string"))


def _card(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*((F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in _FIELDS))


def flat_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """{model: prices for a token}: entries need input and output; cache rates are derived where they are not given."""
    entry = "struct<input_cost_per_token:double,output_cost_per_token:double,cache_creation_input_token_cost:double,cache_read_input_token_cost:double,input_cost_per_token_above_200k_tokens:double,output_cost_per_token_above_200k_tokens:double,cache_creation_input_token_cost_above_200k_tokens:double,cache_read_input_token_cost_above_200k_tokens:double,max_input_tokens:bigint>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "e")).where("e.input_cost_per_token is not null and e.output_cost_per_token is not null")
    e = F.col("e")
    fast = F.element_at(F.create_map(*(F.lit(x) for pair in FAST.items() for x in pair)), F.col("key")) if FAST else F.lit(None)
    return _card(
        rows.select(
            "key", e["input_cost_per_token"].alias("input"), e["output_cost_per_token"].alias("output"), F.coalesce(e["cache_creation_input_token_cost"], e["input_cost_per_token"] * 1.25).alias("create"), F.coalesce(e["cache_read_input_token_cost"], e["input_cost_per_token"] * 0.1).alias("read"),
            e["input_cost_per_token_above_200k_tokens"].alias("input_above"), e["output_cost_per_token_above_200k_tokens"].alias("output_above"), e["cache_creation_input_token_cost_above_200k_tokens"].alias("create_above"), e["cache_read_input_token_cost_above_200k_tokens"].alias("read_above"),
            e["cache_read_input_token_cost"].isNotNull().alias("read_explicit"), F.coalesce(fast, F.lit(1.0)).alias("fast"), e["max_input_tokens"].alias("context"),
        )
    )


def provider_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """{provider: {models: {name: listing}}}, prices for a million tokens. Of a model's listings the maker's own wins, then a priced one, then one with a read price, then the first provider by name; free ones count only from the maker."""
    listing = "struct<id:string,cost:struct<input:double,output:double,cache_read:double,cache_write:double>,limit:struct<context:bigint>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<models:map<string,{listing}>>>")).alias("provider", "p")).select("provider", F.explode("p.models").alias("name", "m"))
    c = F.col("m.cost")
    rows = rows.withColumn("key", F.coalesce("m.id", "name")).where("m.cost.input is not null and m.cost.output is not null")
    rows = rows.withColumns({"official": F.coalesce(F.col("provider") == official_provider(F.col("key")), F.lit(False)), "priced": (c["input"] > 0) | (c["output"] > 0)}).where("official or priced")
    best = Window.partitionBy("key").orderBy(F.desc("official"), F.desc("priced"), F.desc(c["cache_read"].isNotNull()), "provider")
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1")
    per = lambda x: x / 1e6
    return _card(
        rows.select("key", per(c["input"]).alias("input"), per(c["output"]).alias("output"), F.coalesce(per(c["cache_write"]), per(c["input"]) * 1.25).alias("create"), F.coalesce(per(c["cache_read"]), per(c["input"]) * 0.1).alias("read"), c["cache_read"].isNotNull().alias("read_explicit"), F.lit(1.0).alias("fast"), F.col("m.limit.context").alias("context"))
    )


def layered(*cards: DataFrame) -> DataFrame:
    """Cards from weakest to strongest: a key's row comes whole from the strongest that has it."""
    marked = reduce(DataFrame.unionByName, (c.withColumn("_layer", F.lit(i)) for i, c in enumerate(cards)))
    return marked.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_layer")))).where("_n = 1").drop("_n", "_layer")
