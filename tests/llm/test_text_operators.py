"""Operators on text against plain versions, on edge cases and copies."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import queries as Q
from tallyflow.llm.decontamination import decontaminate, near_phrases
from tallyflow.llm.exchange import bucket_count
from tallyflow.llm.line_dedup import dedup_lines
from tallyflow.llm.minhash_dedup import near_duplicates
from tallyflow.llm.substring_dedup import dedup_substrings
from tallyflow.llm.suffix_dedup import dedup_bytes

#: Column names that the operators use inside, as extra columns of their input.
CLASHING = ("bucket", "part", "ord", "text_hash", "pos", "rank", "word", "key", "rep", "pid", "weight", "kept_text", "n", "component", "found", "_gone", "_ord", "_hash", "_lines_ord", "n_lines", "text_id")


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def corpus(seed=3, unique=True):
    """Copies, near copies, shared passages and lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bcdfgé" for b in ("an", "or", "Ist", "ul")]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", "\n")) for _ in range(n))
    passages = [text(60) for _ in range(3)]
    base = [text(rng.randint(20, 120)) for _ in range(12)]
    rows = []
    for d in range(60):
        t = rng.choice(base)
        if d % 3 == 0:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if d % 7 == 0:
            t = text(5) + rng.choice(passages) + "\n" + text(4)
        rows.append((d * 2 + 1, t))
    rows += [(500, None), (501, ""), (502, "   \n\t "), (503, "One"), (504, "one"), (505, "x" * 300), (506, "x" * 300), (507, text(30000)), (508, "two words"), (509, "\n\n\n\n"), (510, "\n\n\n\n\n")]
    if not unique:
        rows += [(1, rows[0][1]), (1, "something else " * 20), (None, base[0]), (None, base[0]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [35, 4, 1])
def test_substring_dedup(spark, window):
    rows = corpus(unique=False)
    got = dedup_substrings(frame(spark, rows), window).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.substrings(rows, window), key=str)


def test_buckets_follow_the_input(spark):
    """With a bound of a few documents a bucket there are more buckets than shuffle partitions, and the same rows."""
    rows = corpus(unique=False)
    df = frame(spark, rows, extra=False)
    size = sum(len((t or "").encode()) + 64 for _, t in rows)
    assert bucket_count(df, F.octet_length("text") + 64, most=5000) >= size // 5000 > 4 == bucket_count(df, F.octet_length("text") + 64)
    assert bucket_count(df.where("false"), F.octet_length("text"), most=5000) == 4
    got = dedup_substrings(df, 35, most=5000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.substrings(rows, 35), key=str)
    got = dedup_bytes(frame(spark, rows[:70], extra=False), 50, block=4000, chunk=512, most=5000).collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == sorted(brute.byte_strings(rows[:70], 50), key=str)


@pytest.mark.parametrize("length", [50, 7, 24])
def test_suffix_dedup(spark, length):
    rows = corpus(unique=False)[:70]
    got = dedup_bytes(frame(spark, rows), length, block=4000, chunk=512).collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == sorted(brute.byte_strings(rows, length), key=str)


def test_line_dedup(spark):
    rows = corpus()
    got = dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.lines(rows), key=str)


def test_line_dedup_rows_equal_in_id_and_text_are_one_document(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, "a\nb\nc")]
    got = dedup_lines(frame(spark, rows, extra=False)).select("doc_id", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (2, 3, "d"), (None, 3, "")], key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_dedup(spark, size):
    rows = corpus()
    got = near_duplicates(frame(spark, rows), size).collect()
    expected = brute.near(rows, size)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_minhash_dedup_of_repeated_and_null_ids(spark):
    t, u = "a b c d e f g h i j", "k l m n o p q r"
    got = near_duplicates(frame(spark, [(3, t), (3, u), (7, u), (None, t), (9, None)])).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 3, True), (3, 3, True), (7, 3, False), (None, None, False), (9, 9, True)], key=str)


def items(seed=5):
    rows = [t for _, t in corpus() if t]
    rng = random.Random(seed)
    long = max(rows, key=len).split()
    return [(1, " ".join(long[100:125])), (2, " ".join(long[5000:5004])), (2, " ".join(long[5000:5004])), (3, None), (4, " .,; "), (5, "never said before"), (None, " ".join(long[7000:7015])), (6, " ".join(rng.sample(long, 12))), (7, rows[0])]


def test_decontamination(spark):
    rows, bench = corpus(), items()
    got = decontaminate(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string").withColumn("word", F.lit(1)), block_words=40)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.contaminated(rows, bench), key=str)


def test_decontamination_of_repeated_null_and_largest_ids(spark):
    last = (1 << 63) - 1
    rows = [(1, "said once before"), (1, "said once before"), (1, "never"), (None, "said once before"), (None, "never"), (last, "said once before"), (last, None)]
    got = decontaminate(frame(spark, rows), spark.createDataFrame([(8, "once before")], "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated")
    assert sorted(map(tuple, got.distinct().collect()), key=str) == sorted(set(brute.contaminated(rows, [(8, "once before")])), key=str)


def test_words_of_two_thousand_bytes_that_cancel_out_in_a_polynomial(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{a} {common}"), (2, f"{b} {common}"), (3, a), (4, b)]
    assert {r["doc_id"]: r["n_removed"] for r in dedup_substrings(frame(spark, rows)).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    found = decontaminate(frame(spark, rows), spark.createDataFrame([(8, a)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == {1, 3}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), 1).collect() if r["doc_id"] > 2} == {3: 3, 4: 4}


def test_proximity_matches_allow_moved_words(spark):
    said = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "so " + said), (2, said.replace("gamma", "gamma uh")), (3, said.replace("beta gamma", "x y z v w u beta gamma")), (4, "alpha beta")]
    got = near_phrases(frame(spark, docs), spark.createDataFrame([(1, said)], "item_id long, text string"), slack=2)
    assert {r["doc_id"] for r in got.collect()} == {1, 2}


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (dedup_substrings(none), dedup_bytes(none), dedup_lines(none), near_duplicates(none), decontaminate(none, bench)):
        assert df.collect() == []
    got = decontaminate(frame(spark, [(1, "a b c"), (2, None)]), bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in got) == [(1, 3, False), (2, 0, False)]


def test_queries_give_their_digests(spark, tmp_path):
    rows = corpus(9)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.byte_strings(rows)}
    got = {r["doc_id"]: r["kept_sha256"] for r in Q.op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: brute.sha(kept) for d, _, _, kept in brute.substrings(rows)}
