"""Strict reading of JSON values (variants) by their own type: a wrong type is told apart from a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    """The type's name: STRING, BIGINT, DECIMAL(...), DOUBLE, BOOLEAN, OBJECT<...>, ARRAY<...>, VOID for a JSON null."""
    return F.schema_of_variant(value)


def string(value: Column) -> Column:
    """A string's text, else null."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def no_string(value: Column) -> Column:
    """Whether there is something that is neither a string nor a JSON null."""
    return F.coalesce(~kind(value).isin("STRING", "VOID"), F.lit(False))


def whole(value: Column) -> Column:
    """A JSON integer that is not negative, else null."""
    return F.when((kind(value) == "BIGINT") & (F.try_variant_get(value, "$", "bigint") >= 0), F.try_variant_get(value, "$", "bigint"))


def no_count(value: Column) -> Column:
    """Whether there is something that is neither a whole number from 0 on nor a JSON null."""
    return F.coalesce(kind(value) != "VOID", F.lit(False)) & whole(value).isNull()


def no_number(value: Column) -> Column:
    return F.coalesce(~kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)"), F.lit(False))


def no_flag(value: Column) -> Column:
    return F.coalesce(~kind(value).isin("BOOLEAN", "VOID"), F.lit(False))


def counter(values: list[Column]) -> Column:
    """The first of several spellings that holds a counter, a whole number or a string of digits: struct n, bad.

    Bad, and without a number, if an object or array stands where one is looked for before that; other types count as missing.
    """

    def read(value: Column) -> Column:
        said = F.trim(F.try_variant_get(value, "$", "string"))
        digits = F.when(kind(value).isin("STRING", "BIGINT") & said.rlike(r"^\d{1,18}$"), said.cast("bigint"))
        return F.struct(digits.alias("n"), F.coalesce(kind(value).rlike("^(OBJECT|ARRAY)"), F.lit(False)).alias("bad"))

    return F.get(F.filter(F.transform(F.array(*values), read), lambda h: h["n"].isNotNull() | h["bad"]), F.lit(0))
