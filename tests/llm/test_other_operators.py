"""Language ID, URL filters, mixing, token counts and neighbours."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import queries as Q
from tallyflow.llm.language_id import held_out, predict, train
from tallyflow.llm.mixing import DIMENSIONS, mix
from tallyflow.llm.nn_descent import nearest
from tallyflow.llm.token_counts import VOCABULARY, count_tokens
from tallyflow.llm.url_filter import filter_urls

SMALL = "/root/testdata/sf0.001"


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in Q.op2_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs)
    aside = [r for r in docs if got[r["doc_id"]]["held_out"] and r["lang"] and r["text"] and any(c.isalpha() for c in r["text"])]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in aside)
    assert aside and right >= 0.95 * len(aside)
    bayes = brute.Bayes((r["text"], r["lang"]) for r in docs if not got[r["doc_id"]]["held_out"])
    same = [bayes.predict(r["text"])[0] == got[r["doc_id"]]["lang_pred"] for r in docs]
    assert sum(same) >= 0.99 * len(same)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_edges(spark):
    rows = [(1, "the cat", "en"), (2, "der Hund", "de"), (3, None, "en"), (4, "12 !?", None), (5, "", "de"), (6, "the the the " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"slot": F.lit(1), "score": F.lit("x")})
    model = train(docs.where("doc_id < 3"))
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", predict(docs, model).alias("p")).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"] and got[4]["score"] == 0
    nothing = train(docs.where("false"))
    assert {r["p"]["lang_pred"] for r in docs.select(predict(docs, nothing).alias("p")).collect()} == {"und"}
    assert docs.where("false").select(predict(docs, model).alias("p")).collect() == []
    assert docs.select(held_out()).count() == 6
    with pytest.raises(ValueError, match="more than 1"):
        train(docs, max_languages=1)


def test_url_filter(spark):
    rng = random.Random(4)
    hosts = ["example.com", "EXAMPLE.net", "a.example.com", "notexample.com", "net", "x.net", "org", "b.org", "com", "ex-ample.com", "example.com.", ""]
    rows = [(i, f"{rng.choice(('http', 'ftp'))}://{rng.choice(hosts)}{rng.choice(('', '/', '/de/', '/de', '/en/a?b=/de/', '#/de/', '/fr/x'))}") for i in range(300)]
    rows += [(900, None), (901, "no scheme/de/"), (902, ""), (903, "://"), (904, "a://b://example.com/de/"), (905, "http://example.com/de/" + "x" * 200000), (1, rows[1][1]), (None, rows[0][1])]
    rules = [*Q.RULES, ("com", "", "allow"), ("a.example.com", "/de/", "allow"), ("example.com", "/d", "block")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "key", "pid", "kind", "rule")})
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("page_id", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.urls(rows, rules), key=str)
    assert filter_urls(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []
    assert {r["verdict"] for r in filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))), rng.choice(["s1", "s1", "s1", "s2", None]), rng.choice(["en", "de"])) for i in range(400)]
    rows += [(1000, None, "s3", None), (None, "a b", "s1", "en"), (5, rows[5][1], *rows[5][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("x") for c in ("topic", "weight", "tokens", "mass", "kept")})
    got = mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept").collect()
    assert len(got) == len(rows)
    cell = lambda r: tuple(r[d] if r[d] is not None else "unknown" for d in DIMENSIONS)
    cells = {}
    for r in got:
        cells[cell(r)] = cells.get(cell(r), 0) + r["n_tokens"]
    total, targets = sum(cells.values()), []
    for k, power in enumerate((0.5, 0.7, 0.5)):
        sums = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        raised = {name: n**power for name, n in sums.items()}
        targets.append({name: v / sum(raised.values()) for name, v in raised.items()})
    weights = brute.fitted(cells, targets, 8)
    for r in got:
        assert r["weight"] == pytest.approx(weights[cell(r)], rel=1e-6) and r["probability"] == pytest.approx(min(1.0, 0.5 * r["weight"]))
    topics = {}
    for r in got:
        topics[cell(r)[2]] = topics.get(cell(r)[2], 0) + r["n_tokens"] * r["weight"]
    assert all(topics[t] / total == pytest.approx(share, abs=1e-6) for t, share in targets[2].items())
    assert mix(docs.where("false")).collect() == []
    assert [r["kept"] for r in got if r["doc_id"] == 5][0] == [r["kept"] for r in got if r["doc_id"] == 5][1]


def test_token_counts(spark):
    import base64

    import tiktoken

    from tallyflow.llm.token_counts import PATTERN

    rows = [(1, "One line\nand another\n\nlast é line"), (2, None), (3, ""), (4, "\n"), (5, "wörd " * 20000), (6, "a\nb"), (6, "a\nb"), (None, "x <|endoftext|> y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("section", "n_tokens", "start_byte")})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for rule in ("start", "end", "most"):
        got = count_tokens(docs, rule=rule).collect()
        for doc, text in {(d, t) for d, t in rows}:
            mine = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["section"])
            times = rows.count((doc, text))
            data = (text or "").encode()
            assert sum(r["n_tokens"] for r in mine) == times * len(plain.encode_ordinary(text or ""))
            assert b"".join(data[r["start_byte"] : r["end_byte"]] for r in mine[::times]) == data
            expected = {}
            begin, starts = 0, [r["start_byte"] for r in mine[::times]]
            for token in plain.encode_ordinary(text or ""):
                size = len(plain.decode_single_token_bytes(token))
                over = [s for s in range(len(starts)) if starts[s] < begin + size and (starts[s + 1] if s + 1 < len(starts) else len(data)) > begin]
                share = [min(begin + size, starts[s + 1] if s + 1 < len(starts) else len(data)) - max(begin, starts[s]) for s in over]
                to = {"start": over[0], "end": over[-1], "most": over[int(np.argmax(share))]}[rule]
                expected[to] = expected.get(to, 0) + 1
                begin += size
            assert {r["section"]: r["n_tokens"] for r in mine if r["n_tokens"]} == expected
    assert count_tokens(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        count_tokens(docs, rule="half")


def test_neighbours_of_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {}
    for r in Q.op1_nn_descent(spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    exact = brute.nearest(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    assert set(got) == set(exact)
    found = sum(len(set(got[q]) & set(exact[q])) for q in exact)
    assert found >= 0.9 * sum(map(len, exact.values()))


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.0]), (100, [2.0, 0.0]), (150, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [3.0, 0.0]), (10, [0.0, -1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "part", "vec", "rank", "query")})
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {50: [9, 100, 150, 10], 100: [9, 50, 150, 10], 150: [9, 50, 100, 10]}
    assert nearest(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest(copies, F.col("vec_id") % 50 == 0).collect()}
    assert [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]


def test_mixing_takes_topics_from_whole_texts(spark):
    from tallyflow.llm.mixing import topics_of_texts

    rng = random.Random(8)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(2)]
    rows = [(i, "the " + " ".join(rng.sample(7 * words[i % 2], 210)), "s", "en") for i in range(40)] + [(90, " ", "s", "en"), (91, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    topic = {r["doc_id"]: r["topic"] for r in mix(docs).collect()}
    assert topic[0] != topic[1] and all(topic[i] == topic[i % 2] for i in range(40)) and topic[90] == topic[91] == "unknown"
    own = {r["doc_id"]: r["topic"] for r in mix(docs.withColumn("topic", F.when(F.col("doc_id") < 90, (F.col("doc_id") % 3).cast("string")))).collect()}
    assert own == {i: str(i % 3) for i in range(40)} | {90: "unknown", 91: "unknown"}
    assert topics_of_texts(docs, F.col("text"), F.col("lang"), "t").where("t is null").count() == 2


def test_mixing_meets_the_targets_of_skewed_sources(spark):
    from tallyflow.llm.mixing import distance, tempered

    rows = [(i, "a b c d", "s1" if i < 900 else "s2" if i < 990 else "s3", "en", "t") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    sums = {}
    for r in mix(docs).collect():
        assert 0 < r["probability"] <= 1
        sums[r["source"]] = sums.get(r["source"], 0) + r["probability"]
    raised = {s: n**0.5 for s, n in (("s1", 900), ("s2", 90), ("s3", 10))}
    for s, n in raised.items():
        assert sums[s] / sum(sums.values()) == pytest.approx(n / sum(raised.values()), abs=1e-9)

    def gap(**how):
        cells = mix(docs, **how).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.first("probability").alias("probability"))
        return distance(cells, {"source": tempered(cells.select("source", "tokens"), "source", 0.5)})["source"]

    assert gap() == pytest.approx(0, abs=1e-9) and gap(clip=True) > 0.04


def test_mixing_query_lowers_first_words_as_its_sql_does(spark, tmp_path):
    from oracle import difference, duck

    first = ["ΟΔΟΣ", "οδοσ", "οδος", "İstanbul", "istanbul", "i̇stanbul", "THE", "the", " x", ""]
    rows = [(i, f"{w} and more", "s1" if i % 3 else "s2", "en") for i, w in enumerate(first * 2)] + [(90, None, None, None), (None, " ", "s1", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert difference(Q.op7_mixing(spark, str(tmp_path)), duck(str(tmp_path)), Q.oracle_sql()["op7_mixing"]) == ""
