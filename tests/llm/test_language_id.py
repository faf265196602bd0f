import math
import random
import zlib

import numpy as np

from heronflow.llm import language_id as ppm


def brute_bits(texts, text):
    """Code length by walking the contexts byte by byte."""
    seen = {}
    for t in texts:
        for k in range(ppm.ORDER + 1):
            for i in range(k, len(t)):
                at = seen.setdefault(t[i - k : i], {})
                at[t[i]] = at.get(t[i], 0) + 1
    total = 0.0
    for i, b in enumerate(text):
        for k in range(min(ppm.ORDER, i), -2, -1):
            if k < 0:
                total += 8
                break
            at = seen.get(text[i - k : i], {})
            n, d = sum(at.values()), len(at)
            if b in at:
                total += math.log2((n + d) / at[b])
                break
            total += math.log2((n + d) / d) if n else 0
    return total


def documents(seed, n):
    rng = random.Random(seed)
    syllables = {"en": ["th", "er", "on", "an", "the "], "de": ["ch", "ei", "ü", "und "], "xx": ["é", "la ", "ci", "ón"]}
    return [(k, "".join(rng.choices(syllables[lang], k=rng.randrange(1, 60))), lang) for k in range(n) for lang in [rng.choice(list(syllables))]]


def test_code_lengths_are_exact(spark):
    rows = documents(1, 60)
    model = ppm.learn(spark.createDataFrame([(lang, t) for _, t, lang in rows], "lang string, text string"))
    probes = [t.encode() for _, t, _ in documents(2, 30)] + [b"", b"t", b"th", b"the", b"\x00\xff", b"zzzzzzzz", "ünd ther ón zz".encode(), b"thethe" * 500]
    want = [[brute_bits([t.encode() for _, t, x in rows if x == lang], p) for lang in model.languages] for p in probes]
    got = model.code_lengths(probes)
    assert np.allclose(got, want, rtol=1e-5)
    assert np.allclose(np.concatenate([model.code_lengths([p]) for p in probes]), want, rtol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents(3, 300) + [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "the ther", None), (None, "und ch", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = ppm.training_rows(docs)
    assert train.count() == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k, t, x in rows if k is not None and t is not None and x)
    got = {r.doc_id: r for r in ppm.identify(docs, ppm.learn(train)).collect()}
    long = [(k, x) for k, t, x in rows if k is not None and k < 1000 and len(t) > 20 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(long) > 30 and sum(got[k].lang_pred == x for k, x in long) >= 0.97 * len(long)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_the_bound_on_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE", 50)
    docs = spark.createDataFrame(documents(4, 900), "doc_id long, text string, lang string")
    counts = {r["lang"]: r["count"] for r in ppm.training_rows(docs).groupBy("lang").count().collect()}
    assert set(counts) == {"en", "de", "xx"} and all(25 <= n <= 80 for n in counts.values())


def test_long_texts_are_counted_whole(spark, monkeypatch):
    rows = [("en", "the er on " * 40), ("en", "x"), ("de", "ünd ch ei " * 30)]
    monkeypatch.setattr(ppm, "PIECE", 7)
    got = {(r.lang, r.k, r.gram): r.n for r in ppm.count_grams(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want: dict = {}
    for lang, t in rows:
        raw = t.encode()
        for k in range(1, ppm.ORDER + 2):
            for i in range(len(raw) - k + 1):
                key = (lang, k, int.from_bytes(raw[i : i + k], "big"))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_numerals_are_no_letters_and_columns_may_clash(spark):
    rows = [(1, "the ther on", "en", "x"), (2, "²½① Ⅷ 12", "en", "x"), (3, "th" * 1_000_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in ppm.identify(docs, ppm.learn(ppm.training_rows(docs.where("doc_id = 1")))).collect()}
    assert got == {1: "en", 2: "und", 3: "en"}


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = ppm.learn(ppm.training_rows(empty))
    assert ppm.identify(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert ppm.identify(docs, model).first()["lang_pred"] == "und"
