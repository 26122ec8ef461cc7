"""Large groups of near copies: every way to settle their keys gives the groups of all pairs, and none makes all pairs."""

import random

import brute
import pytest

from tallyflow.llm import minhash_dedup
from tallyflow.llm.minhash_dedup import near_duplicates


def edited(rng, words, n, vocabulary):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(vocabulary) if vocabulary else f"x{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def group():
    """Variants of two templates that are 0.6 alike, with edits of their own and edits from a small stock."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    other = edited(rng, base, 6, None).split()
    stock = [f"s{i}" for i in range(4)]
    rows = [(10 * i, edited(rng, rng.choice((base, base, other)), rng.randrange(8), rng.choice((None, stock)))) for i in range(420)]
    rows += [(10 * i + 1, t) for i, (_, t) in enumerate(rows[:40])] + [(9999, None), (9998, "a b")]
    rng.shuffle(rows)
    return rows, brute.near(rows)


@pytest.mark.parametrize("how", [{}, {"small": 4, "rounds": 2}, {"small": 8, "exact": True}])
def test_groups_of_all_pairs(spark, group, how):
    rows, want = group
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, **how).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_compared_pairs_follow_the_group(spark, monkeypatch):
    """Members with edits of their own around a template that is not there itself: few of their pairs are compared."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [(i, edited(rng, base, 1 + i % 9, None)) for i in range(500)]
    counted = []
    kept = minhash_dedup.Scratch.keep

    def keep(self, df, name):
        out = kept(self, df, name)
        if name.startswith("pairs-"):
            counted.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup.Scratch, "keep", keep)
    made = []
    for n in (250, 500):
        counted.clear()
        near_duplicates(spark.createDataFrame(texts[:n], "doc_id long, text string"), 4).collect()
        made.append(sum(counted))
    assert made[1] < 500 * 499 / 2 / 8 and made[1] < 4.5 * made[0], made
