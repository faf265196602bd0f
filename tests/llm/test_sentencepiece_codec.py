import random

import numpy as np
import public_tokenizers
import pytest

from heronflow.llm import sentencepiece_codec as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "a", "  a b", "▁x", "a\n b", "\x00a", "a\x00b", "<s>x</s><unk>", "<0x41>", "é", "　x", "ﬁ", "a\tb\r\n", "   ", " a ", "\n", "\n\n a\n", "a▁b", "▁", "x▁ y", "日本語 ok 😀", "a" * 600, "x  \n  y  "]


def test_against_the_library():
    model, rng = sp.Codec(PATH), random.Random(1)
    texts = HARD + ["".join(rng.choices("abcdetionrs  \n▁é😀\x00", k=rng.randrange(200))) for _ in range(500)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.library.encode(text), text
        assert model.decode(ids) == model.library.decode(model.library.encode(text))


def test_heap_and_side_by_side_agree():
    model = sp.Codec(PATH)
    for word in ("▁information", "ononononon", "aaaaaaaaaaaaa", "▁▁▁▁▁▁"):
        symbol, _ = model._side_by_side([word], 16)
        assert symbol[symbol >= 0].tolist() == model._ids(word)


def test_a_difference_is_an_error():
    model = sp.Codec(PATH)
    model.known["▁word"] = b"\x01\x00\x00\x00"
    with pytest.raises(ValueError):
        model.check(["▁word"])


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(sp, "WORDS_KEPT", 3)
    model = sp.Codec(PATH)
    for text in ["one two three four", "two five six one", "one two"]:
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == model.library.encode(text)


def test_very_long_words_are_not_remembered():
    model, rng = sp.Codec(PATH), random.Random(2)
    text = "".join(rng.choices("ABCDefgh0123+/", k=60_000)) + " a b " + "z" * 300
    for _ in range(2):
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == model.library.encode(text)
        assert max(map(len, model.known)) <= sp.LONGEST_KEPT


def test_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z")], "doc_id long, text string, ids string")
    rows = sp.encode_documents(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 2, ""), (1, 4, "a b"), (1, 4, "a b")]
    assert sp.encode_documents(docs.limit(0), PATH).count() == 0
