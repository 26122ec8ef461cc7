"""The find chain over cards of any size: the index of name parts gives what comparing all pairs gives."""

import random
import re

from pyspark.sql import functions as F

from tallyflow.functions import rate_card
from tallyflow.operators import pricing


def holds(value, key):
    """Plain: key between boundaries, and not as an older version of what follows."""
    at = value.find(key) if key else -1
    while at >= 0:
        before, after = value[:at], value[at + len(key) :]
        fine = (not before or not re.match(r"[0-9A-Za-z]", before[-1])) and (not after or not re.match(r"[0-9A-Za-z]", after[0]))
        version = re.match(r"[-.](\d+)(.?)", after) if key[-1:].isdigit() else None
        if fine and not (version and not (len(version[1]) == 8 and not re.match(r"[0-9A-Za-z]", version[2] or "-"))):
            return True
        at = value.find(key, at + len(key))
    return False


def plain(name, layers, aliases):
    dash = lambda x: x.replace(".", "-").replace("@", "-")
    fits = lambda a, b: holds(a, b) or holds(b, a) or holds(dash(a), dash(b)) or holds(dash(b), dash(a))

    def entry(keys, n):
        return n if n in keys else min((k for k in keys if fits(k, n)), key=lambda k: (-len(k), k), default=None)

    def ask(keys, n):
        if n in keys:
            return n
        other = rate_card.ALIASES.get(n)
        return (entry(keys, other) if other else None) or entry(keys, n)

    clean = re.sub(r"^\[[^\]]*\]\s*", "", name.strip().lower())
    resolved = aliases.get(clean, clean)
    found = ask(layers[0], name)
    if found is not None:
        return 0, found
    return next(((k, hit) for k, keys in enumerate(layers) if (hit := ask(keys, resolved)) is not None), None)


def card(spark, keys):
    return spark.createDataFrame([(k, 1.0, 2.0, 0.0, 0.0, None, None, None, None, None, False, 1.0, 1000 + len(k)) for k in keys], rate_card.SCHEMA)


def names_and_keys(n, some=60):
    rng = random.Random(8)
    families = ["gpt", "claude", "claude-opus", "claude-sonnet", "glm", "kimi-k2", "qwen3", "acme"]
    vendors = ["", "", "openai/", "anthropic.", "vertex_ai/", "us.", "moonshot/"]
    version = lambda: rng.choice(["4", "5", "4.6", "4-6", "5.1", "3.5", "5.1-codex", "4@20250514", "4-20250514", "4-2025051", "turbo", "5-mini", "v2:0"])
    made = [f"{rng.choice(vendors)}{rng.choice(families)}-{version()}" + (f"-x{rng.randrange(n)}" if rng.random() < 0.7 else "") for _ in range(n)]
    asked = [rng.choice(["", "[pi] ", "openrouter/", "x-"]) + k + rng.choice(["", "-20250101", ".1", "-preview", "@latest"]) for k in rng.sample(made, some)]
    asked += ["gpt-5", "gpt-5.6", "[omp] GPT-5.6", "gpt-5.9", "claude", "5", "--", "", "nothing", "mine", "Mine ", "gpt-5.3-spark", "glm-4.6", "opus"]
    return asked, list(dict.fromkeys(made))


def test_index_equals_all_pairs_on_a_large_catalogue(spark, monkeypatch):
    asked, keys = names_and_keys(5000, 16)
    names = spark.createDataFrame([(a,) for a in asked * 2] + [(None,)], "model string")
    catalogue, own = card(spark, keys), rate_card.card(spark)
    aliases = {"mine": "claude-opus-4-6"}
    layers = [own, card(spark, ["gpt-5.9", "--", "live-only"]), catalogue]
    sets = [[r[0] for r in rate_card.rows()], ["gpt-5.9", "--", "live-only"], keys]
    want = {a: plain(a, sets, aliases) for a in asked}
    monkeypatch.setattr(pricing, "SMALL_CARD", 0)
    found = pricing.find_keys(names, layers, aliases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["name"]: (r["layer"], r["key"]) for r in found.collect()} == {a: w for a, w in want.items() if w}
    assert want["mine"] == (0, "claude-opus-4-6") and want["gpt-5.6"] == (0, "gpt-5.6-sol") and want["gpt-5.9"] == (1, "gpt-5.9") and any(w and w[0] == 2 for w in want.values())


def test_small_cards_give_the_same(spark, monkeypatch):
    asked, _ = names_and_keys(300)
    asked += ["gpt-5-20260101", "gpt-5.4@x", "claude-sonnet-4-5", "zai/glm-4.5-air", "glm-4.5v"]
    names, own = spark.createDataFrame([(a,) for a in asked], "model string"), rate_card.card(spark)
    each = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(pricing, "SMALL_CARD", most)
        each.append(sorted(map(tuple, pricing.resolve_models(names, own).collect())))
    assert each[0] == each[1] == sorted((a, w[1]) for a in set(asked) if (w := plain(a, [[r[0] for r in rate_card.rows()]], {})))


def test_context_limits_go_by_the_same_chain(spark):
    own = rate_card.card(spark).withColumn("context", F.when(F.col("key") != "gpt-5.1", F.col("context")))
    names = spark.createDataFrame([("[pi] claude-opus-4-6",), ("gpt-5.1-codex",), ("kimi-k2.5",), ("unknown",), (None,)], "model string")
    got = {r["name"]: (r["key"], r["context"]) for r in pricing.context_limits(names, [own, card(spark, ["gpt-5.1-codex", "other"])]).collect()}
    assert got == {"[pi] claude-opus-4-6": ("claude-opus-4-6", 1_000_000), "gpt-5.1-codex": ("gpt-5.1-codex", 1013), "kimi-k2.5": ("moonshot/kimi-k2.5", 262144)}
