"""Prices for usage entries: every distinct model name is resolved once, then rates are joined back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rate_card
from ..functions.text import clean_model, dashed

_RATE = [f.split()[0] for f in rate_card.SCHEMA.split(", ")]


def holds_key(value: Column, key: Column) -> Column:
    """Whether `value` holds `key` between characters that are no letters or digits, and not as an older version.

    A key that ends in a digit is no part of a longer version number, but may have a date of eight digits behind it.
    """
    newer = F.when(key.rlike(r"\d$"), F.lit(r"(?![-.](?!\d{8}(?![0-9A-Za-z]))\d)")).otherwise(F.lit(""))
    return F.call_function("rlike", value, F.concat(F.lit(r"(?<![0-9A-Za-z])\Q"), key, F.lit(r"\E(?![0-9A-Za-z])"), newer))


#: A card of so many bytes at most is sent to every task and compared with every name.
SMALL_CARD = 1 << 20


def _is_small(card: DataFrame) -> bool:
    return int(str(card._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_CARD


def fits(wanted: Column, key: Column) -> Column:
    """Either name holds the other, as written or with hyphens for dots and at signs."""
    return holds_key(wanted, key) | holds_key(key, wanted) | holds_key(dashed(wanted), dashed(key)) | holds_key(dashed(key), dashed(wanted))


def _parts(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(name, F.lit("[0-9A-Za-z]+"), F.lit(0)))


def fitting_keys(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """(wanted, key) of all names and keys that fit, without comparing every name with every key.

    What holds a name between boundaries has all its parts, the runs of letters and digits. So a key can only be
    in a name that has the key's rarest part, and a name only in keys that have the name's rarest part; pairs
    that share such a part are compared, others cannot fit. Names without parts only fit themselves.
    """
    wanted, keys = wanted.select("wanted").distinct(), keys.select("key").distinct()
    held = keys.select("key", F.explode(_parts(F.col("key"))).alias("part"))
    often = held.groupBy("part").agg(F.count("*").alias("n"))
    asked = wanted.select("wanted", F.explode(_parts(F.col("wanted"))).alias("part")).join(often, "part")
    rarest = lambda rows, name: rows.groupBy(name).agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    inside = asked.select("wanted", "part").join(rarest(held.join(often, "part"), "key"), "part").select("wanted", "key")
    around = rarest(asked, "wanted").join(held, "part").select("wanted", "key")
    pairs = inside.unionByName(around).where(fits(F.col("wanted"), F.col("key")))
    return pairs.unionByName(wanted.join(keys, F.col("wanted") == F.col("key")).select("wanted", "key")).distinct()


def find_keys(names: DataFrame, layers: list[DataFrame], aliases: dict[str, str] | None = None, column: str = "model") -> DataFrame:
    """name, layer, key: the row of the first card that prices each distinct name.

    The first card is asked for the name as it is, then for the clean name or what the user's `aliases` make of
    it; further cards (live prices, a catalogue) for the latter alone. Each asking takes the exact key, then that
    of a name's fixed alias, exact or fitting, then the longest key that fits, of equals the first in order.
    """
    clean = clean_model(F.col("name"))
    resolved = F.coalesce(*(F.when(clean == a, F.lit(b)) for a, b in (aliases or {}).items()), clean)

    def fixed(name: Column) -> Column:
        return F.coalesce(*(F.when(name == a, F.lit(b)) for a, b in rate_card.ALIASES.items()))

    def asking(first: int, layer: int, name: Column) -> list[Column]:
        return [F.struct(F.lit(layer).alias("layer"), F.lit(first + exact).alias("if_exact"), F.lit(first + fuzzy).alias("if_fits"), c.alias("wanted")) for exact, fuzzy, c in ((0, 3, name), (1, 2, fixed(name)))]

    every = asking(0, 0, F.col("name"))
    for k in range(len(layers)):
        every += asking(4 * (k + 1), k, resolved)
    tries = names.select(F.col(column).alias("name")).where("name is not null").distinct().select("name", F.explode(F.array(*every)).alias("t")).select("name", "t.*").where("wanted is not null")
    keys = reduce(DataFrame.unionByName, (card.select(F.lit(k).alias("layer"), "key") for k, card in enumerate(layers)))
    if all(map(_is_small, layers)):
        hits = tries.join(F.broadcast(keys), (tries["layer"] == keys["layer"]) & ((tries["wanted"] == keys["key"]) | fits(tries["wanted"], keys["key"]))).drop(keys["layer"])
    else:
        hits = tries.join(fitting_keys(tries, keys), "wanted").join(keys, ["layer", "key"], "left_semi")
    turn = F.when(F.col("wanted") == F.col("key"), F.col("if_exact")).otherwise(F.col("if_fits"))
    best = Window.partitionBy("name").orderBy(turn, F.desc(F.length("key")), "key")
    return hits.withColumn("n", F.row_number().over(best)).where("n = 1").select("name", "layer", "key")


def resolve_models(names: DataFrame, card: DataFrame, column: str = "model", aliases: dict[str, str] | None = None) -> DataFrame:
    """For each distinct name the key of its price on one card."""
    return find_keys(names, [card], aliases, column).select("name", "key")


def find_prices(names: DataFrame, layers: list[DataFrame], aliases: dict[str, str] | None = None, column: str = "model") -> DataFrame:
    """name, layer, key and the struct `rate` of the first card that prices each distinct name; names without a price are left out."""
    rows = [card.select(F.lit(k).alias("layer"), "key", F.struct(*_RATE).alias("rate")) for k, card in enumerate(layers)]
    return find_keys(names, layers, aliases, column).join(reduce(DataFrame.unionByName, rows), ["layer", "key"]).select("name", "layer", "key", "rate")


def context_limits(names: DataFrame, layers: list[DataFrame], aliases: dict[str, str] | None = None, column: str = "model") -> DataFrame:
    """name, key and context, the window in tokens, by the same chain over the rows of the cards that have one."""
    known = [card.where("context is not null") for card in layers]
    return find_prices(names, known, aliases, column).select("name", "key", F.col("rate.context").alias("context"))


def with_rates(entries: DataFrame, card: DataFrame, column: str = "model", aliases: dict[str, str] | None = None) -> DataFrame:
    """`entries` with a struct `rate`, null where no price fits."""
    keys = resolve_models(entries, card, column, aliases)
    rates = keys.join(F.broadcast(card) if _is_small(card) else card, "key").select(F.col("name").alias("_name"), F.struct(*_RATE).alias("rate"))
    return entries.join(rates, F.col(column) == F.col("_name"), "left").drop("_name")


def family_rates(models: DataFrame, card: DataFrame) -> DataFrame:
    """For names without a price: that of the longest ancestor name, cut at hyphens; cache rates of 0 are derived. name, rate, source."""
    found = with_rates(models.select("model").distinct(), card)
    seed = found.where("rate is not null").select("model", "rate", F.lit("seed").alias("source"))
    parts = F.split("model", "-")
    lost = found.where("rate is null").drop("rate").withColumn("cut", F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))))
    tried = with_rates(lost.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), "-")), card, "ancestor").where("rate is not null")
    longest = tried.withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("cut")))).where("n = 1")
    rate = F.col("rate")
    derived = rate.withField("read", F.when((rate["read"] == 0) & (rate["input"] > 0), 0.1 * rate["input"]).otherwise(rate["read"])).withField(
        "create", F.when((rate["create"] == 0) & (rate["input"] > 0), 1.25 * rate["input"]).otherwise(rate["create"])
    )
    return seed.unionByName(longest.select("model", derived.alias("rate"), F.lit("family").alias("source")))


def review_model(events: DataFrame, ladder: DataFrame, date: str = "usage_date", default: str = "gpt-5") -> DataFrame:
    """As-of join: `events` with `model`, the latest of the ladder that was out on the date."""
    steps = ladder.select(F.col("released"), F.lead("released").over(Window.orderBy("released")).alias("until"), F.col("model").alias("_model"))
    held = (F.col(date) >= F.col("released")) & (F.col("until").isNull() | (F.col(date) < F.col("until")))
    return events.join(F.broadcast(steps), held, "left").withColumn("model", F.coalesce("_model", F.lit(default))).drop("released", "until", "_model")


def review_fallback(model: Column, date: Column) -> Column:
    """The same for one expression: what an automatic review's name stands for on a date, other names as they are."""
    steps = [line.split() for line in rate_card.REVIEW_LADDER.split("\n") if line]
    out = F.lit("gpt-5")
    for released, name in steps:
        out = F.when(date >= released, F.lit(name)).otherwise(out)
    return F.when(model == rate_card.REVIEW, out).otherwise(model)


def merge_overrides(seed: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """All keys of both; where both have one, the override's value wins, field by field where it is not null."""
    fields = [c for c in seed.columns if c != key]
    other = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return seed.join(other, key, "full_outer").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in fields))
