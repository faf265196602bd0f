import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heronflow.llm import token_store as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_is_the_library(library, monkeypatch):
    monkeypatch.setattr(T, "PIECES", 50)
    pick = random.Random(1)
    parts = ["a", "It", "'s", "we'll", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", "　", "​", "é", "漢字", "²", "Ⅷ", "٣", "12", "#", "Ġ", "<|endoftext|>", "\U0001f600", "é", "\x00"]
    texts = ["", " ", "x" * 50_000] + ["".join(pick.choices(parts, k=pick.randrange(1, 30))) for _ in range(3000)]
    encoder = T.Encoder(PATH, "<u2")
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [d for k in range(0, len(texts), 100) for d in encoder.encode(texts[k : k + 100])] == want
    assert len(encoder.known) <= 50


def test_index():
    make = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        ids, ks = np.arange(n) * 7 - 100, np.arange(n) % 3
        at = make.integers(0, 2**40, n)
        index = T.Index.from_bytes(T.Index.build(ids, ks, np.arange(n), at, np.arange(n)).to_bytes())
        found, there = index.find(ids, ks)
        assert there.all() and (found["at"] == at).all() and sorted(index._slots(ids, ks)[0].tolist()) == list(range(n))
        assert not index.find(ids + 1, ks)[1].any() and not index.find(ids, ks + 9)[1].any()


def test_store(spark, library):
    rows = [(k, f"text {k} of many, déjà vu") for k in range(300)] + [(None, "no id"), (None, None), (5, "again"), (900, ""), (901, "long " * 60_000)] + [(77, "hot")] * 400
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, k int").repartition(5)
    store = T.write_store(docs, PATH)
    assert store.kind == "<u2" and store.parts.count() == store.n_parts
    got = sorted(T.fetched(store, store.entries).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert (order := [r.doc_id for r in got if r.doc_id is not None]) == sorted(order)
    start = 0
    for r in got:
        assert r.start == start and r.n == len(r.ids) and r.ids[-1] == T.END
        start += r.n
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids[:-1]) for r in got) == want
    assert len({(r.doc_id, r.k) for r in got}) == len(rows) and max(r.k for r in got) == 400
    checks = {(r.doc_id, r.k): r.crc32 for r in T.fetched(store, store.entries, check=True).collect()}
    assert checks == {(r.doc_id, r.k): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    asked = spark.createDataFrame([(5, 1), (5, 2), (12345, 0), (None, 1), (77, 399)], "doc_id bigint, k bigint")
    assert {(r.doc_id, r.k): r.shard is not None for r in T.looked_up(store, asked).collect()} == {(5, 1): True, (5, 2): False, (12345, 0): False, (None, 1): True, (77, 399): True}


def test_empty(spark):
    store = T.write_store(spark.createDataFrame([], "doc_id bigint, text string"), PATH)
    assert T.fetched(store, store.entries).collect() == []
    assert [r.shard for r in T.looked_up(store, spark.createDataFrame([(1, 0)], "doc_id bigint, k bigint")).collect()] == [None]


def test_even_texts_are_joined_for_a_batch(library, monkeypatch):
    """Texts of single blanks and line feeds need no list of pieces each; the
    order of the batch is kept."""
    texts = ["", "one two,\nthree four. one", "\ntwo", "one ", "two  blanks", "a\tb", " one two", "", "nul\x00 here", "three\n"]
    encoder = T.Encoder(PATH, "<u2")
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    monkeypatch.setattr(T, "UNITS", None)
    even = [0, 1, 2, 3, 6, 7, 9]
    assert encoder.encode([texts[k] for k in even]) == [want[k] for k in even]
