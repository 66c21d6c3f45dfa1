"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece

from quern.llm import piece_bpe
from quern.llm.queries import op12_piece, vocabulary

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


@pytest.fixture(scope="module")
def code():
    return piece_bpe.Codec(vocabulary(MODEL))


def texts():
    rng = random.Random(5)
    parts = ["a", "b", "er", "t", "he", "in", "▁", " ", "    ", "é", "日", "本", "\n", "\t", "😀", "0", "12", "...", "‍", "a" * 9, "\0", "<s>", "<0x41>", "�", "ab" * 4, " " * 17, "\U0010ffff", "क्", " t", "ing"]
    out = [None, "", " ", "  ", "x" * 3000, " " * 2000, "the " * 2000]
    out += ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    out += ["".join(rng.choices(letters, k=rng.randint(1, 200))) for letters in ("ehtr", "abcdefghijklmnopqrstuvwxyz") for _ in range(200)]
    return out + [" " * k for k in range(40)] + ["x" + " " * k + "y" for k in range(40)]


def test_equal_to_the_library(code, library):
    asked = [t or "" for t in texts()]
    got = [x.tolist() for x in code.encode_batch(asked)]
    want = library.encode(asked)
    assert got == want
    assert [code.decode(x) for x in got] == [library.decode(x).encode() for x in got]


def test_pieces_end_to_end(code, library):
    """Texts made of pieces that were not split this way, so that many merges compete."""
    rng = random.Random(7)
    asked = ["".join(rng.choices(code.pieces[259:], k=rng.randint(1, 12))) for _ in range(3000)]
    assert [x.tolist() for x in code.encode_batch(asked)] == library.encode(asked)


def test_decoding_of_any_ids(code, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 8))]
        assert code.decode(ids) == library.decode(ids).encode(), ids


def test_long_texts_in_slices_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "GROUP", 500)
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 300)
    rng = random.Random(1)
    asked = ["".join(rng.choices("ehtr", k=4000)), "the cat sat " * 400, "日本 " * 900, " " * 1500, *["short text"] * 3, "q" * 501]
    assert [x.tolist() for x in piece_bpe.Codec(vocabulary(MODEL)).encode_batch(asked)] == library.encode(asked)


def test_rows(spark, library):
    """Null and repeated ids, repeated rows, null texts, other columns with names of the result, an empty table."""
    asked = [(None, "a b", "x"), (None, None, "x"), (3, "same", "y"), (3, "same", "y"), (4, "<s> é 語", None)]
    df = spark.createDataFrame(asked, "doc_id long, text string, n_tokens string").repartition(2)
    got = sorted(map(tuple, piece_bpe.encode_documents(df, vocabulary(MODEL), keep_ids=True).collect()), key=str)
    want = []
    for i, t, _ in asked:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    assert got == sorted(want, key=str)
    assert piece_bpe.encode_documents(df.limit(0), vocabulary(MODEL)).collect() == []
    back = piece_bpe.decode_documents(piece_bpe.encode_documents(df, vocabulary(MODEL), keep_ids=True).select("doc_id", "ids", "n_tokens"), vocabulary(MODEL), name="n_tokens")
    assert sorted(r.n_tokens for r in back.collect()) == sorted(t or "" for _, t, _ in asked)
    assert piece_bpe.decode_documents(spark.createDataFrame([(None,)], "ids array<int>"), vocabulary(MODEL)).first().decoded is None


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_piece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
