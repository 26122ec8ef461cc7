import json

from pyspark.sql import functions as F

from tallyflow.functions import rate_card
from tallyflow.operators import render
from tallyflow.sources import prices


def test_catalogues(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"m1": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "max_input_tokens": 9}, "m2": {"input_cost_per_token": 1e-6}, "gpt-5": {"input_cost_per_token": 9e-6, "output_cost_per_token": 9e-6, "cache_read_input_token_cost": 1e-7}}, indent=1))
    flat = {r["key"]: r for r in prices.flat_catalogue(spark, str(tmp_path / "flat.json")).collect()}
    assert set(flat) == {"m1", "gpt-5"} and abs(flat["m1"]["create"] - 1.25e-6) < 1e-15 and not flat["m1"]["read_explicit"] and flat["gpt-5"]["read_explicit"] and flat["m1"]["context"] == 9
    cost = lambda i, o, **c: {"cost": {"input": i, "output": o} | c}
    listed = {"aaa": {"models": {"gpt-9": cost(5, 6, cache_read=1), "free": cost(0, 0), "x": cost(1, 1)}}, "openai": {"models": {"gpt-9": cost(0, 0)}}, "bbb": {"models": {"x": cost(2, 2, cache_read=0.5), "y": {"id": "z", **cost(3, 3)}}}}
    (tmp_path / "by.json").write_text(json.dumps(listed))
    by = {r["key"]: r["input"] for r in prices.provider_catalogue(spark, str(tmp_path / "by.json")).collect()}
    assert by == {"gpt-9": 0.0, "x": 2e-6, "z": 3e-6}
    both = prices.layered(prices.flat_catalogue(spark, str(tmp_path / "flat.json")), rate_card.card(spark))
    assert {r["key"]: r["input"] for r in both.where("key in ('gpt-5', 'm1')").collect()} == {"gpt-5": 1.25e-6, "m1": 1e-6}
    who = lambda n: spark.range(1).select(prices.official_provider(F.lit(n)).alias("x")).first()["x"]
    assert [who(n) for n in ("GPT-5", "ministral-3", "acme")] == ["openai", "mistral", None]


def test_float_text():
    assert [render.float_text(x) for x in (0.0, 1.0, 0.1, 123456789.25, 1e16, 1.5e-6, 1e-5, float("nan"), -2.5e20)] == ["0.0", "1.0", "0.1", "123456789.25", "1.0e16", "1.5e-6", "0.00001", "null", "-2.5e20"]


def test_rows_and_lines(spark):
    df = spark.range(1).select(F.lit("p").alias("project"), F.lit("2026-01-01").alias("date"), F.lit(0.5).alias("cost"), F.array(F.struct(F.lit("m").alias("model"), F.lit(1.0).alias("cost"))).alias("models"))
    assert json.loads(render.json_rows(df, "date", "cost", "models").first()[0]) == {"date": "2026-01-01", "cost": 0.5, "models": [{"model": "m", "cost": 1.0}]}
    assert json.loads(render.json_rows(df, with_cost=False).first()[0]) == {"project": "p", "date": "2026-01-01", "models": [{"model": "m"}]}
    assert render.by_project(df.select("project", "date")).first()["rows"][0]["date"] == "2026-01-01"
    assert render.status_line("Opus", 1, 2, None, None, 5000, 200000) == "Opus | $1.00 session / $2.00 today / No active block | 5,000 (3%)"
    assert render.settings({"a": 1, "b": {"c": 1}}, {"b": {"d": 2}}, {"a": 3}) == {"a": 3, "b": {"c": 1, "d": 2}}
