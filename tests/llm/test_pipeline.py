"""Every stage of the pipeline against a plain version, on the documents that the stage before kept."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyflow.llm.language_id import held_out
from tallyflow.llm.minhash_dedup import near_duplicates
from tallyflow.llm.mixing import mix

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = docs.collect()
        if name == "language_id":
            aside = {r["doc_id"] for r in docs.where(held_out()).collect()}
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            bayes = brute.Bayes((r["text"], r["lang"]) for r in before if r["doc_id"] not in aside)
            said = {r["doc_id"]: bayes.predict(r["text"]) for r in before}
            assert set(after) == {d for d, (lang, score) in said.items() if lang != "und" and score >= P.SURE}
        if name == "line_dedup":
            found = brute.lines([(r["doc_id"], r["text"]) for r in before])
            assert after == {d: kept for d, _, gone, _, kept in found if not gone or kept.strip(" ")}
        if name == "minhash_dedup":
            found = brute.near([(r["doc_id"], r["text"]) for r in before], 5)
            assert set(after) == {d for d, (_, low) in found.items() if d == low}
        if name == "decontamination":
            found = brute.contaminated([(r["doc_id"], r["text"]) for r in before], bench)
            assert set(after) == {r[0] for r in found if not r[-1]}
        if name == "mixing":
            mixed = mix(spark.read.parquet(f"{tmp_path}/decontamination"))
            assert set(after) == {r["doc_id"] for r in mixed.where("kept").collect()} and after


def test_run_passes_rows_on(spark, tmp_path):
    rows = [(i, f"the {i} cat sat on a mat and then the dog {i} came in {i}", "en", "s", 10) for i in range(40)] + [(99, None, None, None, None), (98, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()}
    assert got and got <= set(range(40))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []


def test_near_dedup_keeps_one_row_a_group_whatever_the_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k, e: text(k) + f" edit{e}"
    rows = [(None, text(0)), (None, text(1)), (None, near(1, 1)), (None, text(1)), (4, text(2)), (4, text(2)), (5, text(3)), (None, near(3, 1))]
    # Two texts under one id: near copies of either belong to its group.
    rows += [(6, text(4)), (6, text(5)), (7, near(4, 1)), (8, near(5, 1)), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.minhash_dedup(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [4, 5, 6, 9, 10]
    nameless = [r["text"] for r in got if r["doc_id"] is None]
    assert len(nameless) == 2 and text(0) in nameless and set(nameless) - {text(0)} <= {text(1), near(1, 1)}
    named = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert named == {4: (4, True), 5: (5, True), 6: (6, True), 7: (6, False), 8: (6, False), 9: (9, True), 10: (10, True)}


def test_clashing_columns_missing_ids_repeated_rows_and_a_long_text(spark, tmp_path):
    clash = ("topic", "N_Tokens", "weight", "probability", "kept", "n_lines", "kept_text", "n_removed", "_said", "_bad_ord", "ord", "text_hash", "bucket", "component_id", "score")
    words = lambda k, n: " ".join(f"the {k} cat{(k * 7919 + i * i) % 997} sat on a mat{i}" for i in range(n))
    rows = [(i, words(i, 12), "en", "s", 10) for i in range(60)] + [(None, words(100 + i, 12), "en", "s", 10) for i in range(5)] + [(7, words(7, 12), "en", "s", 10)] * 3
    rows += [(200, words(200, 30000), "en", None, 10), (201, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0)).cast("string")) for c in clash})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "mix_topic", "mix_n_tokens", "mix_weight", "mix_probability"]
    kept = got.collect()
    assert kept and all(r[c] == f"{c}-{r['doc_id'] or 0}" for r in kept for c in clash)
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 201 not in ids
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id is null").count() == 5
