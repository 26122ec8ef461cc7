"""Costs in US dollars from token counters and the rate columns of the rate card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens above which a higher rate holds, and the price of an hour's cache write over input.
MARGINAL_FROM, HOUR_WRITE = 200_000, 2


def cache_5m() -> Column:
    """Five-minute cache writes: the split counter where there is a split, else the flat one."""
    return F.when(F.col("cache_split").isNotNull(), F.coalesce("cache_split.c5m", F.lit(0))).otherwise(F.coalesce("cache_flat", F.lit(0)))


def cache_1h() -> Column:
    return F.coalesce(F.col("cache_split.c1h"), F.lit(0))


def cache_create() -> Column:
    return cache_5m() + cache_1h()


def tokens() -> Column:
    return F.col("input") + F.col("output") + cache_create() + F.col("cache_read")


def tiered(count: Column, base: Column, above: Column, threshold: int = MARGINAL_FROM) -> Column:
    """Tokens up to the threshold at the base rate, those beyond it at the higher one, if there is one."""
    return F.when(above.isNotNull() & (count > threshold), threshold * base + (count - threshold) * above).otherwise(count * base)


def _buckets() -> list[tuple[Column, Column, Column]]:
    rate, above = (lambda n: F.col(f"rate.{n}")), (lambda n: F.col(f"rate.{n}_above"))
    return [
        (F.col("input"), rate("input"), above("input")),
        (F.col("output"), rate("output"), above("output")),
        (cache_5m(), rate("create"), above("create")),
        (cache_1h(), rate("input") * HOUR_WRITE, above("input") * HOUR_WRITE),
        (F.col("cache_read"), rate("read"), above("read")),
    ]


def marginal_cost() -> Column:
    return sum((tiered(*b) for b in _buckets()), F.lit(0.0))


def whole_request_cost() -> Column:
    """All of a request at the higher rates once its input passes the model's own threshold."""
    long = F.col("input") > F.col("rate.threshold")
    return sum((n * F.when(long, F.coalesce(above, base)).otherwise(base) for n, base, above in _buckets()), F.lit(0.0))


def token_cost() -> Column:
    """Needs a `rate` struct; 0 without model or price."""
    plain = F.when(F.col("rate.threshold").isNotNull(), whole_request_cost()).otherwise(marginal_cost())
    fast = F.when(F.col("speed") == "fast", F.col("rate.fast")).otherwise(F.lit(1.0))
    return F.when(F.col("model").isNull() | F.col("rate").isNull(), F.lit(0.0)).otherwise(plain * fast)


def cost(mode: str = "auto") -> Column:
    """display: what was recorded; calculate: from tokens; auto: recorded, else from tokens."""
    if mode == "display":
        return F.coalesce("cost_usd", F.lit(0.0))
    return F.coalesce("cost_usd", token_cost()) if mode == "auto" else token_cost()


def missing_model(mode: str = "auto") -> Column:
    """The model whose price is missing, where a price was needed."""
    if mode == "display":
        return F.lit(None).cast("string")
    needed = (tokens() > 0) & F.col("rate").isNull()
    return F.when(needed & F.col("cost_usd").isNull() if mode == "auto" else needed, F.col("model"))


def card_cost(card: str = "rate") -> Column:
    """The leaderboard's linear cost: no tiers, no fast premium."""
    return (
        F.col("input") * F.col(f"{card}.input")
        + F.col("output") * F.col(f"{card}.output")
        + F.col("cache_read") * F.col(f"{card}.read")
        + F.col("cache_5m") * F.col(f"{card}.create")
        + F.col("cache_1h") * F.col(f"{card}.input") * HOUR_WRITE
    )


def card_savings(card: str = "rate") -> Column:
    """What cache reads saved against plain input, less the premium on cache writes."""
    base = F.col(f"{card}.input")
    return F.col("cache_read") * (base - F.col(f"{card}.read")) - F.col("cache_5m") * (F.col(f"{card}.create") - base) - F.col("cache_1h") * (base * HOUR_WRITE - base)


def codex_bucket_cost(prefix: str = "") -> Column:
    """A codex usage bucket: the long-context part at the higher rates, cached input at an explicit read rate only."""
    c = lambda n: F.col(f"{prefix}{n}")
    less = lambda a, b: F.greatest(a - b, F.lit(0))
    base, out, explicit = F.col("rate.input"), F.col("rate.output"), F.col("rate.read_explicit")
    read = F.when(explicit, F.col("rate.read")).otherwise(base)
    long_base = F.coalesce("rate.input_above", "rate.input")
    long_read = F.when(explicit, F.coalesce("rate.read_above", "rate.read")).otherwise(long_base)
    long_in = F.least(c("long_input"), c("input"))
    long_cached = F.least(c("long_cached"), c("cached"), long_in)
    long_out = F.least(c("long_output"), c("output"))
    short_cached = less(c("cached"), long_cached)
    return (
        less(less(c("input"), long_in), short_cached) * base
        + short_cached * read
        + less(c("output"), long_out) * out
        + less(long_in, long_cached) * long_base
        + long_cached * long_read
        + long_out * F.coalesce("rate.output_above", "rate.output")
    )
