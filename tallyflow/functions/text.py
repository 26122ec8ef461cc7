"""Model names, overlaps and fallbacks that many sources share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_model(name: Column) -> Column:
    """Trimmed, lower case, without a leading [tag]."""
    return F.regexp_replace(F.lower(F.trim(name)), r"^\[[^\]]*\]\s*", "")


def without_date(name: Column) -> Column:
    """Without a trailing release date, -YYYY-MM-DD or -YYYYMMDD."""
    return F.regexp_replace(name, r"(?<=.)(-\d{4}-\d\d-\d\d|-\d{8})$", "")


def dashed(name: Column) -> Column:
    return F.translate(name, ".@", "--")


def short_model(name: Column) -> Column:
    """For tables: no vendor prefix, no trailing part of eight characters."""
    bare = F.regexp_replace(name, r"^(anthropic/)?claude-", "")
    return F.regexp_replace(bare, r"(?<=.)-[^-]{8}$", "")


def display_model(model: Column, speed: Column) -> Column:
    """No model for synthetic messages; a fast request is told apart by its name."""
    return F.when(model == "<synthetic>", F.lit(None)).when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model)


def provider_of(model: Column, rules: dict[str, str], default: str = "unknown") -> Column:
    """The provider of the first prefix that fits."""
    return reduce(lambda out, r: F.when(F.startswith(model, F.lit(r[0])), F.lit(r[1])).otherwise(out), reversed(list(rules.items())), F.lit(default))


def droid_model(name: Column) -> Column:
    """Without `custom:` and [parts]; lower case; dots and spaces become single inner hyphens."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^custom:", ""), r"\[[^\[\]]*\]", ""), r"\[[^\[\]]*\]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(bare)), r"[.\s-]+", "-"), r"^-|-$", "")


def without_overlap(input: Column, cached: Column) -> Column:
    """Input of a source whose counter includes cached tokens."""
    return F.greatest(input - cached, F.lit(0))


def total_fallback(output: Column, extra: Column, known: Column, total: Column) -> tuple[Column, Column]:
    """Tokens that only the total counts: they are output where there is none, else extra."""
    missing = F.greatest(F.coalesce(total, F.lit(0)) - known, F.lit(0))
    return F.when(output == 0, output + missing).otherwise(output), F.when(output == 0, extra).otherwise(extra + missing)


def count(value: Column) -> Column:
    """A token counter: whole and not negative, else 0."""
    return F.greatest(F.coalesce(value.cast("bigint"), F.lit(0)), F.lit(0))


def any_count(text: Column) -> Column:
    """A counter from JSON text that may be quoted; fractions and other text are null."""
    return F.when(text.rlike(r"^\d{1,18}$"), text.cast("bigint"))


def grouped(value: Column) -> Column:
    return F.format_number(value, 0)


def currency(value: Column) -> Column:
    return F.format_string("$%.2f", value)


def cn_units(value: Column) -> Column:
    """Large counts in units of 10^4 and 10^8."""
    return F.when(value >= 100_000_000, F.format_string("%.2f亿", value / 1e8)).when(value >= 10_000, F.format_string("%.1f万", value / 1e4)).otherwise(value.cast("string"))


def reset_ms(line: Column) -> Column:
    """When a usage limit ends: the digits after the marker's bar, in seconds."""
    digits = F.regexp_extract(line, r"Claude AI usage limit reached[^|]*\|(\d{1,12})", 1)
    return F.when((digits != "") & (digits.cast("bigint") > 0), digits.cast("bigint") * 1000)
