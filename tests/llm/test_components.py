"""Connected components: alternating stars give what a plain search gives, at once or link table by link table."""

import random

import pytest

from tallyflow.llm.components import components, joined
from tallyflow.llm.scratch import Scratch


@pytest.mark.parametrize("steps", [1, 3])
def test_components(spark, steps):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    low = {n: n for link in links for n in link}
    for _ in range(len(low)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    scratch, groups = Scratch(spark, "test"), None
    for k in range(steps):
        groups = joined(groups, df.where(f"pmod(a * 7 + b, {steps}) = {k}"), scratch, f"c{k}")
    got = {r["node"]: r["component"] for r in groups.collect()}
    if steps == 1:
        assert got == {r["node"]: r["component"] for r in components(df, scratch, "whole").collect()}
    alone = {n for n in low if all(a == b for a, b in links if n in (a, b))}
    assert {n: c for n, c in got.items() if n not in alone} == {n: c for n, c in low.items() if n not in alone}
