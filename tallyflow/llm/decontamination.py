"""Benchmark decontamination with a distributed positional inverted index.

Items are phrases of `window` consecutive words. Corpus frequencies rank each phrase's words; the index
stores the postings (document, word positions) of the two rarest words of every phrase. Offset-adjusting
the rarest word's postings gives document/item alignments, which are intersected with the second word's
postings; only documents that survive have the postings of all item words read. An alignment's matched
words that form a run of at least a phrase are exact occurrences. `near` searches the same postings with
a slack on every offset.

Words are compared by 64-bit fingerprints. Items are handled in blocks of at most `block_words` words, so
what is broadcast, a block's distinct words, is bounded whatever the size of the benchmark.

Defined results: null texts and texts without words have no words and no hits; an item shorter than a phrase
is one phrase; an item without id marks words but is not counted or named; rows equal in id and text are one
document and share its result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .identity import DOCUMENT as _DOC
from .identity import doc_id, document
from .scratch import Scratch
from .textkit import LOWER, NON_ALNUM, Words, pieces, text_bytes



def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = text_bytes(texts)
    w = Words(LOWER[data], offsets, NON_ALNUM)
    return w, w.hashes().view(np.int64)


def _item_words(batches):
    """A row for each word of each item: item, its number of words, position, word."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            w, h = _words(piece["text"])
            item = np.repeat(np.arange(len(w.counts)), w.counts)
            yield pa.RecordBatch.from_arrays(
                [piece["item"].take(pa.array(item)), piece["item_id"].take(pa.array(item)), pa.array(w.counts[item].astype(np.int32)), pa.array((np.arange(len(h)) - w.first[:-1][item]).astype(np.int32)), pa.array(h)],
                names=["item", "item_id", "size", "at", "word"],
            )


def _place(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in the sorted `known` of each value, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _word_counts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        known = held.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                at = _place(_words(piece["text"])[1], known)
                total += np.bincount(at[at >= 0], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(total[some])], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Postings of the given words: document, word, n_words of the document, positions. Word 0 stands for the document itself."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def post(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                w, h = _words(piece["text"])
                some = np.flatnonzero(_place(h, held.value) >= 0)
                doc = np.searchsorted(w.first, some, "right") - 1
                order = np.lexsort((some, h[some], doc))
                some, doc = some[order], doc[order]
                new = np.ones(len(some), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[some][1:] != h[some][:-1])
                at = np.flatnonzero(new)
                whole = np.arange(len(w.counts))
                row = np.concatenate((doc[at], whole))
                word = np.concatenate((h[some][at], np.zeros(len(whole), np.int64)))
                bound = np.concatenate((at, np.full(len(whole) + 1, len(some)))).astype(np.int32)
                positions = pa.ListArray.from_arrays(pa.array(bound), pa.array((some - w.first[:-1][doc]).astype(np.int32)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([piece["ord"].take(take), piece["text_hash"].take(take), pa.array(w.counts[row].astype(np.int64)), pa.array(word), positions], names=[*_DOC, "n_words", "word", "positions"])

    return docs.select(*_DOC, "text").mapInArrow(post, "ord long, text_hash long, n_words long, word long, positions array<int>")


def _collected(words: DataFrame) -> np.ndarray:
    """Distinct words of one block, sorted; at most `block_words`."""
    return np.sort(words.select("word").distinct().toArrow()["word"].to_numpy().astype(np.int64))


class Block:
    """The phrases of one block of items, the corpus index for them, and the alignments its two rarest words give."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int, scratch: Scratch, name: str, slack: int = 0):
        counts = scratch.keep(_word_counts(docs, _collected(items)), f"{name}-counts")
        start = F.explode(F.sequence(F.greatest(F.col("at") - (window - 1), F.lit(0)), F.least(F.col("at"), F.greatest(F.col("size") - window, F.lit(0)))))
        terms = items.join(counts, "word", "left").select("item", F.least("size", F.lit(window)).alias("length"), start.alias("start"), "at", "word", F.coalesce("n", F.lit(0)).alias("n"))
        by = Window.partitionBy("item", "start")
        terms = terms.withColumn("least", F.min("n").over(by)).where("least > 0").withColumn("rarity", F.row_number().over(by.orderBy("n", "at")))
        self.terms = scratch.keep(terms.select("item", "start", "length", "at", "word", "rarity"), f"{name}-terms")
        anchors = self.terms.where("rarity <= 2")
        self.postings = scratch.keep(index(docs, _collected(anchors)), f"{name}-index")
        posting = self.postings.where("word <> 0").select(*_DOC, "word", F.explode("positions").alias("pos"))
        one = self.terms.where("rarity = 1").select("item", "start", "length", "word", F.col("at").alias("at1"))
        two = self.terms.where("rarity = 2").select("item", "start", F.col("word").alias("word2"), F.col("at").alias("at2"))
        pairs = one.join(two, ["item", "start"], "left").select("item", "word", "at1", "word2", "at2", "length", *(["start"] if slack else [])).distinct()
        placed = posting.join(pairs, "word").withColumn("shift", F.col("pos") - F.col("at1"))
        other = posting.select(*_DOC, F.col("word").alias("word2"), F.col("pos").alias("pos2"))
        both = placed.where("length > 1").withColumn("pos2", F.col("shift") + F.col("at2"))
        if slack:
            near = other.withColumnRenamed("pos2", "real2")
            both = both.join(near, [*_DOC, "word2"]).where(F.abs(F.col("real2") - F.col("pos2")) <= slack)
        else:
            both = both.join(other, [*_DOC, "word2", "pos2"], "left_semi")
        columns = [*_DOC, "item", "shift", *(["start", "length"] if slack else [])]
        self.found = scratch.keep(both.select(*columns).union(placed.where("length = 1").select(*columns)).distinct(), f"{name}-found")
        candidates = docs.join(self.found.select(*_DOC).distinct(), _DOC, "left_semi")
        full = scratch.keep(index(candidates, _collected(items)), f"{name}-full")
        self.posting = full.where("word <> 0").select(*_DOC, "word", F.explode("positions").alias("pos"))

    def exact(self, items: DataFrame, window: int) -> DataFrame:
        """Document positions within an exact phrase: document, item_id, pos."""
        matched = self.found.join(items, "item").withColumn("pos", F.col("shift") + F.col("at")).join(self.posting.distinct(), [*_DOC, "word", "pos"], "left_semi")
        line = Window.partitionBy(*_DOC, "item", "shift")
        matched = matched.withColumn("island", F.col("at") - F.row_number().over(line.orderBy("at")))
        run = F.count("*").over(Window.partitionBy(*_DOC, "item", "shift", "island"))
        return matched.withColumn("run", run).where(F.col("run") >= F.least("size", F.lit(window))).select(*_DOC, "item_id", "pos")

    def near(self, items: DataFrame, slack: int) -> DataFrame:
        """Phrases all of whose words lie within `slack` of their places: document, item_id, start of the phrase in the item, first_pos, last_pos."""
        want = self.found.join(self.terms.drop("length", "rarity"), ["item", "start"])
        hits = want.join(self.posting, [*_DOC, "word"]).where(F.abs(F.col("pos") - F.col("shift") - F.col("at")) <= slack)
        whole = hits.groupBy(*_DOC, "item", "start", "shift", "length").agg(F.countDistinct("at").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")).where("n = length")
        names = items.select("item", "item_id").distinct()
        return whole.groupBy(*_DOC, "item", "start").agg(F.min("first_pos").alias("first_pos"), F.min("last_pos").alias("last_pos")).join(names, "item").drop("item")


def _prepared(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, block_words: int, id_col: str, text_col: str, item_col: str) -> tuple[DataFrame, list[DataFrame]]:
    base = docs.select(*document(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("item_id"), F.col("text"))
    items = scratch.keep(items.mapInArrow(_item_words, "item long, item_id string, size int, at int, word long"), "items")
    blocks = -(-items.count() // block_words)
    return base, [items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    base, blocks = _prepared(docs, benchmark, scratch, block_words, id_col, text_col, item_col)
    made = [(Block(base, items, window, scratch, f"block{k}"), items) for k, items in enumerate(blocks)]
    hits = scratch.keep(reduce(DataFrame.union, (b.exact(items, window) for b, items in made)), "hits")
    count = hits.groupBy(*_DOC).agg(F.countDistinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    every = made[0][0].postings.where("word = 0").select(*_DOC, "n_words")
    out = every.join(count, _DOC, "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(doc_id().alias("doc_id"), "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def near_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 2, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Proximity matches: doc_id, item_id, start (of the phrase in the item), first_pos, last_pos."""
    scratch = Scratch(docs.sparkSession, "near-phrases")
    base, blocks = _prepared(docs, benchmark, scratch, block_words, id_col, text_col, item_col)
    found = [Block(base, items, window, scratch, f"block{k}", slack).near(items, slack) for k, items in enumerate(blocks)]
    return reduce(DataFrame.union, found).select(doc_id().alias("doc_id"), "item_id", "start", "first_pos", "last_pos")
