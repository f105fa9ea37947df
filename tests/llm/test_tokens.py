import json
import os

import pytest

from lychnos.llm import tokens
from lychnos.llm.tokens import VOCABULARIES, decode, encode, encoder, safe_pieces

pytestmark = pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="no vocabularies here")

TEXTS = ["", None, " ", "Hello world's 3rd\n\n  text", "Νέα στέγη <|endoftext|> ñ", "‍👩‍🔧\r\n\t", "a" * 3000, "x y\n" * 2000, "tie", "tie"]


def frame(spark):
    return spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")


def test_round_trip_and_defined_ids(spark):
    ids = encode(frame(spark), "doc_id", "text")
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[0] == [] and got[1] == [] and got[2]
    assert got[8] == got[9]
    back = {r.doc_id: r.text for r in decode(ids, "doc_id").collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    assert 50256 not in {i for v in got.values() for i in v}


def test_equals_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    some = [x for x in TEXTS if x]
    assert encoder()(some) == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["word " * 50, "a\n\n b  c\t" * 30, "nospace" * 40, "1 2  3   4    " * 20, "Ελλη νικά και τέλος " * 10])
@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_do_not_change_the_ids(text, size):
    parts = safe_pieces(text, size)
    assert "".join(parts) == text
    enc = encoder()
    assert [i for p in parts for i in enc([p])[0]] == enc([text])[0]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_vocabularies(spark, name):
    got = {r.doc_id: r.ids for r in encode(frame(spark), "doc_id", "text", name).collect()}
    assert got[0] == [] and got[1] == [] and got[3]


def test_decoding_by_every_kind_of_file(spark):
    for name in ("byte_bpe_multi_50k", "piece_bpe_32k"):
        ids = encode(spark.createDataFrame([(1, "Hello world's 3rd text"), (2, None)], "doc_id bigint, text string"), "doc_id", "text", name)
        assert {r.doc_id: r.text.strip() for r in decode(ids, "doc_id", name=name).collect()} == {1: "Hello world's 3rd text", 2: ""}


def test_counts(spark):
    rows = {r.doc_id: r.n_tokens for r in tokens.count_tokens(frame(spark), "text", ["doc_id"]).collect()}
    assert rows[0] == 0 and rows[3] == len(encoder()([TEXTS[3]])[0])
    assert encode(frame(spark).limit(0), "doc_id", "text").count() == 0
    assert json.dumps(rows)
