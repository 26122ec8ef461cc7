"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tallyflow.llm.collocations import collocations


def plain(rows, min_count, longest=5, top=2000, absorbed=100):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = {q[i : i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= absorbed * found.get(q[i : i + m], 0)}
        listed = []
        for p, a in found.items():
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                listed.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def rows(n=400, seed=2):
    rng = random.Random(seed)
    runs = ["new york city", "of the", "as well as", "été à la plage", "zz top", "a a a a a a", "one two three four five six", "New York"]
    out = []
    for _ in range(n):
        parts = [rng.choice(runs) if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        out.append(("".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n"]) for p in parts), rng.choice(["en", "en", "fr", None, "und", ""])))
    return out + [(None, "en"), ("", "fr"), (" ,;\n", "de"), ("\x00 b \x00 b", "en")] + [("hot copy of a text, hot copy of a text", "en")] * 300


@pytest.mark.parametrize(("block", "part", "longest"), [(1 << 24, 1 << 21, 5), (3000, 500, 5), (20000, 100, 2), (20000, 100, 3)])
def test_against_plain_counting(spark, block, part, longest):
    made = rows()
    docs = spark.createDataFrame(made, "text string, lang string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("doc_id", "id", "phrase", "a", "n", "rank", "length", "words", "_over")})
    got = collocations(docs, min_count=8, longest=longest, top=25, block=block, part=part).collect()
    assert sorted(map(tuple, got)) == plain(made, 8, longest, 25) and len(got) > 30


def test_absorbed_share_and_languages(spark):
    made = [("a b c", "en")] * 9 + [("a b", "en")] + [("a b c. b c", "x" * 20)] * 10 + [("a b c. b c", "x" * 19 + "y")] * 3
    docs = spark.createDataFrame(made, "text string, lang string")
    for absorbed in (100, 90, 50):
        got = collocations(docs, min_count=3, absorbed=absorbed).collect()
        assert sorted(map(tuple, got)) == plain(made, 3, absorbed=absorbed)


def test_long_text_and_nothing(spark):
    made = [("x y z " * 70000, "en")]
    docs = spark.createDataFrame(made, "text string, lang string")
    assert sorted(map(tuple, collocations(docs).collect())) == plain(made, 100)
    assert collocations(docs.where("false")).collect() == [] and collocations(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_products_beyond_64_bits(spark):
    made = [("p q", "en")] * 4000 + [("p r", "en")] * 3000 + [("q", "en")] * 10
    docs = spark.createDataFrame(made, "text string, lang string")
    assert sorted(map(tuple, collocations(docs).collect())) == plain(made, 100)
    from tallyflow.llm.collocations import _exact

    big = spark.range(1).select(_exact(F.lit(1000), F.lit(10**15), F.lit(10**16)).alias("over"), _exact(F.lit(10**15), F.lit(3 * 10**15)).alias("under")).selectExpr("over div under as score").first()
    assert big["score"] == 1000 * 10**15 * 10**16 // (3 * 10**30)


def test_cells_are_small_and_lose_no_frequent_fingerprint():
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    from tallyflow.llm import collocations as C

    rng = np.random.default_rng(4)
    often = rng.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2)
    shards = [np.concatenate((often, rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2))) for _ in range(4)]
    sent = [C._send_cells(k, keys >> np.uint64(32), np.full(len(keys), 25), 3) for k, keys in enumerate(shards)]
    whole = [C._send(k, keys, keys, np.full(len(keys), 25), 3) for k, keys in enumerate(shards)]
    assert 3 * sum(t.nbytes for t in sent) < sum(t.nbytes for t in whole)
    table = pa.concat_tables(sent)
    told = pa.concat_tables([C._full(100)(table.filter(pa.compute.equal(table["part"], p))) for p in range(3)])
    for k in range(4):
        full = C._told(told.filter(pa.compute.equal(told["id"], k)))[0]
        assert C._held(often >> np.uint64(32), full).all() and len(full) < 1000
    assert C._send_cells(1, np.zeros(0, np.uint64), np.zeros(0, np.int64), 3).num_rows == 0
