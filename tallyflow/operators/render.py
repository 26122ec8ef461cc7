"""Report rows as JSON text, the status line, and the settings that commands take."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COSTS = ("totalCost", "costUSD", "cost")


def float_text(value: float) -> str:
    """Shortest digits that read back the same, with a fraction; an exponent outside 1e-5 to 1e16; null for no number."""
    if not math.isfinite(value):
        return "null"
    if value and not 1e-5 <= abs(value) < 1e16:
        sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
        text = "".join(map(str, digits))
        return f"{'-' * sign}{text[0]}.{text[1:] or '0'}e{exponent + len(text) - 1}"
    text = format(Decimal(repr(value)), "f")
    return text if "." in text else text + ".0"


def _without(names: list[str]):
    return lambda x: x.dropFields(*names)


def json_rows(rows: DataFrame, *columns: str, with_cost: bool = True) -> DataFrame:
    """One JSON object a row, in the order of the columns; without cost, none of its fields at any depth of one array."""
    keep = [c for c in (columns or rows.columns) if with_cost or c not in COSTS]
    fields = []
    for c in keep:
        kind = rows.schema[c].dataType
        inner = getattr(getattr(kind, "elementType", None), "names", None)
        drop = [n for n in inner or () if n in COSTS]
        fields.append(F.transform(c, _without(drop)).alias(c) if drop and not with_cost else F.col(c))
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def by_project(rows: DataFrame) -> DataFrame:
    """project and its rows by date."""
    return rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != "project")))).alias("rows"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100)).otherwise(0).cast("bigint")


def status_line(model: str, session_cost: float, today_cost: float, block_cost: float | None, left: str | None, context: int, limit: int) -> str:
    """Model, costs of session, day and block, and how full the context is."""
    share = int(math.floor(context / limit * 100 + 0.5)) if limit else 0
    block = f"${block_cost:.2f} block ({left})" if block_cost is not None else "No active block"
    return f"{model} | ${session_cost:.2f} session / ${today_cost:.2f} today / {block} | {context:,} ({share}%)"


def settings(*layers: dict) -> dict:
    """Nested settings from weakest to strongest: defaults, commands, a tool's own, the command line."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
