import random

import numpy as np
import pytest

from heronflow.llm import blocks as B
from heronflow.llm import suffix_dedup as dedup


def brute(rows):
    """rows: (doc_id, bytes); ids may be None."""
    least = {}
    for k, t in rows:
        if k is not None:
            for i in range(len(t) - 49):
                s = t[i : i + 50]
                least[s] = min(least.get(s, k), k)
    out = []
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if k is not None and least[t[i : i + 50]] < k:
                gone[i : i + 50] = True
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((k, len(t), int(gone.sum()), int(spans), bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_against_brute_force(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(B, "CHUNK", 128)
    rng = random.Random(7)
    make = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [make(n) for n in (48, 49, 50, 51, 70, 130, 200)]
    rows = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 300), (5, "ab" * 80), (6, "ba" * 60)]
    for k in range(7, 110):
        parts = [make(rng.randrange(60)) for _ in range(3)] + [p[rng.randrange(8) : len(p) - rng.randrange(8)] for p in rng.choices(passages, k=rng.randrange(4))]
        rng.shuffle(parts)
        rows.append((None if k == 20 else k, "".join(parts)))
    rows += [(k + 1000, t) for k, t in rows[30:50] if k] + [(40, rows[41][1]), (40, rows[40][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string")
    if hot == 1:  # by the place in files
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup.drop_repeated(docs).collect()]
    want = brute([(k, (t or "").encode()) for k, t in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[2] for x in got) > 1000


def test_suffix_order_and_collisions():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 700)
    length = rng.integers(0, 90, 700)
    group = rng.integers(0, 9, 700)
    order, common = dedup.suffix_order(data, start, length, group)
    slow, slow_common = dedup._order_of_bytes(data, start, length, group)
    key = lambda k: (group[k], data[start[k] : start[k] + length[k]].tobytes())
    assert [key(k) for k in order] == [key(k) for k in slow]
    assert (common == slow_common).all()


def test_a_collision_is_found(monkeypatch):
    data = np.frombuffer(b"abcabdabe", np.uint8)
    start, length, group = np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.int64)
    monkeypatch.setattr(dedup, "_BYTE", np.zeros(256, np.uint64))
    order, common = dedup.suffix_order(data, start, length, group)
    assert order.tolist() == [0, 1, 2] and common.tolist() == [-1, 2, 2]


def test_cut_documents_keeps_characters_and_columns(spark):
    shared = "é" * 25 + "x" * 40
    docs = spark.createDataFrame([(1, shared, 65), (2, "start " + shared + " ü end", 80), (3, shared, 65), (None, shared, 65)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in dedup.cut_documents(docs).collect()}
    assert got == {1: (shared, 65), 2: ("start  ü end", 12), None: (shared, 65)}


def test_equal_rows_are_dealt_to_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    spark.createDataFrame([(None, "")] * 300 + [(7, "same text " * 20)] * 300, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    sizes = B.sized(docs, 0.08, 4 << 20, 12)
    counts = [r["count"] for r in B.in_blocks(docs, sizes).groupBy("block").count().collect()]
    assert sizes.blocks > 10 and max(counts) < 4 * 600 / sizes.blocks
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in dedup.drop_repeated(docs).collect()} == {(None, 0, 0), (7, 200, 0)}


def test_clashing_columns_and_a_very_long_text(spark):
    long = "".join(random.Random(1).choices("abcdefgh \n", k=3_000_000))
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, "tail " + long, 6, "y")], "doc_id long, text string, _null int, kept string")
    got = {r.doc_id: (r.text, r._null, r.kept) for r in dedup.cut_documents(docs).collect()}
    assert got == {1: (long, 5, "x"), 2: ("tail ", 6, "y")}


def test_empty(spark):
    assert dedup.drop_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_of_a_shard_give_the_same(monkeypatch):
    rng = random.Random(4)
    base = [bytes(rng.choices(b"abc", k=90)) for _ in range(6)]
    runs, anchors = [], []
    for _ in range(400):
        b = rng.choice(base)
        at = rng.randrange(20, 40)
        low, high = rng.randrange(at - 10, at), rng.randrange(at + 50, 91)
        runs.append(b[low:high])
        anchors.append(at - low)
    anchors, doc = np.array(anchors), np.array([rng.randrange(50) for _ in runs], np.int64)
    want = dedup.least_documents(runs, anchors, doc)
    monkeypatch.setattr(dedup, "PART_BYTES", 3_000)
    assert sum(map(len, runs)) > 5 * 3_000
    got = dedup.by_parts(runs, anchors, doc)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_cells_of_minimizers_are_spread_over_shards():
    data = np.random.default_rng(5).integers(97, 123, 200_000).astype(np.uint8)
    key = B.minimizers(data, dedup.GRAM, dedup.WINDOW, B.window_starts(np.array([len(data)]), dedup.WINDOW), by=dedup._BYTE)[3]
    sizes = B.Sizes(455_000_000, 0.08, 4 << 20, dedup.SPARE_BITS)
    held = np.diff(sizes.cuts(np.unique(sizes.cells(key))))
    assert sizes.shards == 32 and held.max() < 1.5 * held.mean()
