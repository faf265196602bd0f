"""The pipeline against the brute-force versions of its stages."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from test_near_copies import brute as brute_classes
from test_suffix_dedup import brute as brute_cut

from heronflow.llm import decontaminate, quality_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, f"{text(14)}. {text(6)}.") for k in range(4)]
    passage = text(30)
    rows = []
    for k in range(70):
        body = text(rng.randrange(20, 140))
        if k % 7 == 1:
            body = f"{body} {passage} ü {text(40)}"
        if k % 11 == 2:
            body = f"{body} {items[k % 4][1]} {text(30)}"
        if k % 13 == 3:
            body = "same three words " * 40
        rows.append((k, body, "en", f"s{k % 3}", len(body)))
    for k in (5, 9, 14, 20):  # near copies: a word of some hundred is another one
        words = (rows[k][1] + " " + text(120)).split()
        whole, near = " ".join(words), " ".join([*words[:60], "other", *words[61:]])
        rows[k] = (k, whole, "en", "s1", len(whole))
        rows.append((300 + k, near, "en", "s1", len(near)))
    rows += [(100 + k, rows[k][1], "en", "s0", rows[k][4]) for k in range(0, 40, 5)] + [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    return rows, items


def test_against_brute_force(spark, tmp_path):
    rows, items = corpus(random.Random(9))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {k for k, *_, kept in db.execute(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall() if kept}
    texts = {k: t for k, t, *_ in rows if k in kept}
    assert 20 < len(texts) < len(rows)
    classes = brute_classes(list(texts.items()))
    one = {k for k, least in classes.items() if k == least}
    assert len(one) < len(texts) and {305, 309, 314, 320} & texts.keys() and not {305, 309, 314, 320} & one
    cut = {k: (text.decode() if n else texts[k]) for k, _, n, _, text in brute_cut([(k, texts[k].encode()) for k in sorted(one)])}
    assert cut != {k: texts[k] for k in one}
    sets = [tuple(map(decontaminate.shingles, decontaminate.split_item(t))) for _, t in items]
    clean = {}
    for k, t in cut.items():
        mine = decontaminate.shingles(decontaminate._words(t.lower()))
        if not any(len(q & mine) >= 0.8 * len(q) or len(w & mine) >= 0.8 * len(w) for q, _, w in sets):
            clean[k] = t
    assert len(clean) < len(cut)
    assert {k: r["text"] for k, r in got.items()} == clean
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in got.values():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"], add_bos=True, add_eos=True)
        assert r["lossless"] and r["n_chars"] == len(r["text"])


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "decontamination", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, str(tmp_path))
        assert out.columns[:5] == empty.columns and (k == 4 or len(out.columns) == 5)
        assert out.count() == 0


def test_long_texts_repeated_ids_and_ties(spark, tmp_path):
    """A text of 200,000 words goes through whole; of rows that have one id, and
    of equal texts, the stages keep what their docstrings say."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    short = " ".join(f"v{k}" for k in range(80))
    rows = [(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, short, "en", "t", len(short)), (3, short, "en", "t", len(short)), (4, short, "de", "t", len(short)), (None, short + " end", "en", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30)) + ". No."), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {r["doc_id"]: r for r in got}
    assert whole[1]["text"] == long and whole[1]["lossless"] and 2 not in whole and 4 not in whole
    assert whole[3]["text"] == short and all(r["lossless"] for r in got)
