"""Piece encoding against the library itself: ids, normalised text, offsets and decoded text."""

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyflow.llm import queries as Q
from tallyflow.llm.piece_encoding import MODEL, Model, _field, encode_pieces, fields

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "   ", "a", " a  b ", "a\x00b", "é", "é x", "ﬁ ligature", "Å ｱｲ  ﾊﾞ", "日本語　テキスト ", "👍🏽 ok", "▁x", " nbsp​.", "line\nend\r\n", "１２３ ½", "x" * 3000, "�", "  ́", "<s> </s> <0x41>"]


def batch(texts):
    held = [t if isinstance(t, bytes) else t.encode() for t in texts]
    return np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in held])))


def with_normaliser(spec, **flags):
    """The model file with another normaliser, and other symbols of its own."""
    with open(MODEL, "rb") as f:
        held = f.read()
    return b"".join(_field(k, v) for k, v in fields(held) if k != 3) + _field(3, spec + b"".join(_field({"prefix": 3, "extra": 4, "escape": 5}[k], v) for k, v in flags.items()))


def rule(name):
    spec = sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    return b"".join(_field(k, v) for k, v in fields(dict(fields(spec))[3]) if k in (1, 2))


def texts():
    rng = random.Random(5)
    some = ["ab", " ", "  ", "é", "é", "ﬁ", "　", "ｶﾞ", "日", "👍", "́̂", "\t", "Å", "½", "​", "한", "한", "\x01"]
    return ODD + ["".join(rng.choice(some) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("flags", [{"prefix": a, "extra": b, "escape": c} for a in (True, False) for b in (True, False) for c in (True, False)])
@pytest.mark.parametrize("name", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_normalised_text_is_the_librarys(name, flags):
    held = with_normaliser(rule(name), **flags)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=held), Model(held)
    cases = [t for t in texts() if "▁" not in t] if name == "identity" else texts()
    out, bounds, align, stop = own.normalise(*batch(cases))
    _, offsets = batch(cases)
    for k, t in enumerate(cases):
        want, places = library.normalize(t, with_offsets=True)
        mine = out[bounds[k] : bounds[k + 1]].tobytes().decode()
        assert mine == want, (t, mine, want)
        # the library counts characters of the source: take the first byte of each of ours
        source = align[bounds[k] : bounds[k + 1]] - offsets[k]
        first = np.cumsum([0, *(len(c.encode()) for c in mine)])[: len(mine)]
        chars = [len(t.encode()[:b].decode(errors="ignore")) for b in source[first]]
        assert chars == places[: len(mine)], t
        if mine:
            assert len(t.encode()[: stop[k] - offsets[k]].decode(errors="ignore")) == places[len(mine)]


@pytest.mark.parametrize("name", ["identity", "nmt_nfkc"])
def test_ids_and_spans_are_the_librarys(name):
    held = with_normaliser(rule(name)) if name != "identity" else open(MODEL, "rb").read()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=held), Model(held)
    cases = texts()
    ids, starts, ends = own.encode(*batch(cases))
    assert ids == library.encode(cases)
    at = 0
    for t, own_ids in zip(cases, ids, strict=True):
        k, at = at, at + len(own_ids)
        proto = library.encode(t, return_type="proto")
        for a, b, p in zip(starts[k:at], ends[k:at], proto.pieces, strict=True):
            assert (a, b) == (p.begin, p.end), (t, p)
        assert list(starts[k:at])[1:] == list(ends[k:at])[:-1]


def test_bytes_that_are_no_utf8():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Model(open(MODEL, "rb").read())
    cases = [b"a\xff b", b"\xc3", b"\xe2\x81", b"\xed\xa0\x80x", b"\xf0\x80\x80\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf", b"ok", b"\x80\x80", b"\xf0\x9f\x91", b"\xe0\x9f\xbf"]
    ids, _, _ = own.encode(*batch(cases))
    assert ids == library.encode(cases)


def test_own_symbols_come_first():
    own = b"".join(_field(k, v) for k, v in fields(open(MODEL, "rb").read()) if k == 1)
    rest = b"".join(_field(k, v) for k, v in fields(open(MODEL, "rb").read()) if k not in (1, 3))
    symbols = b"".join(_field(1, _field(1, s.encode()) + b"\x18\x04") for s in ("ﬁx", "<sep>"))
    held = own + symbols + rest + _field(3, rule("nmt_nfkc"))
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=held), Model(held)
    cases = ["a ﬁxed <sep> ﬁ", "<sep><sep>", "ﬁﬁx"]
    assert mine.encode(*batch(cases))[0] == library.encode(cases)


class Heard:
    """A segmenter that counts the bytes it is given."""

    def __init__(self, inner):
        self.inner, self.sizes = inner, []

    def encode(self, texts, **how):
        self.sizes += map(len, texts)
        return self.inner.encode(texts, **how)


def test_every_different_word_is_segmented_once():
    own = Model(open(MODEL, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(9)
    words = ["word", "longer-word", "日本語", "▁", "é", "x" * 300, "", "", "\ufffd", "1,234.5"]
    cases = ["", " ", "▁", " a", "a ", *(rng.choice((" ", "  ", "▁", "▁ ")).join(rng.choice(words) for _ in range(200)) for _ in range(50))]
    own.segmenter = heard = Heard(own.segmenter)
    ids, _, _ = own.encode(*batch(cases))
    assert ids == library.encode(cases)
    assert sum(heard.sizes) < sum(len(t.encode()) for t in cases) / 10


def test_pieces_across_words_are_found():
    more = b"".join(_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", 1)) for p in ("f▁", "f▁t"))
    held = open(MODEL, "rb").read() + more
    library, own = sentencepiece.SentencePieceProcessor(model_proto=held), Model(held)
    cases = ["the cat of the", "x of the  y", "of the", "of  the"]
    ids = own.encode(*batch(cases))[0]
    assert not own.by_words and ids == library.encode(cases)
    assert "f▁t" in library.id_to_piece(ids[0])


def test_unknown_pieces_across_words():
    # without byte pieces, unknown ones that follow each other are one
    top = fields(open(MODEL, "rb").read())
    held = b"".join(_field(k, b"\x18\x02" if k == 2 else v) for k, v in top if k != 1 or dict(fields(v)).get(3, 1) != 6 and dict(fields(v))[1] != "▁".encode())
    library, own = sentencepiece.SentencePieceProcessor(model_proto=held), Model(held)
    cases = ["\x01 \x02 word \x03", "", "a \U000e0001 \U000e0002"]
    assert not own.by_words and own.encode(*batch(cases))[0] == library.encode(cases)


def test_query_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in Q.op11_piece_encoding(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "")
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids) and mine["n_bytes_covered"] == len((r["text"] or "").encode())
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, None), (2, ""), (3, "a b " * 60000), (4, "same"), (4, "same"), (None, " x "), (5, "\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "starts", "ends", "decoded")})
    got = sorted(encode_pieces(docs).collect(), key=str)
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows), key=lambda r: str(r[0]))
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got), key=str) == sorted(want, key=str)
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) for r in got)
    assert encode_pieces(docs.where("false")).collect() == []


def test_query_on_texts_without_pieces(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), hashed(",".join(map(str, ids))), hashed(library.decode(ids)), len(t or "")) for i, t in rows]
    assert sorted(map(tuple, Q.op11_piece_encoding(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
