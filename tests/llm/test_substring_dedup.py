import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from heronflow.llm import blocks as B
from heronflow.llm import substring_dedup as dedup


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(B, "CHUNK", 64)
    rng = random.Random(2)
    make = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n)]
    passages = [make(n) for n in (34, 35, 36, 60, 90)]
    texts = [None, "", " ", "x " * 34, "x " * 35, "x " * 36, "ü b " * 100]
    for _ in range(90):
        parts = [make(rng.randrange(30)) for _ in range(4)] + rng.choices(passages, k=rng.randrange(3))
        rng.shuffle(parts)
        texts.append(rng.choice(["  ", " ", "\n"]).join(sum(parts, [])))
    texts += texts[20:24]
    docs = spark.createDataFrame([(None if k == 30 else k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup.drop_repeated(docs).collect())
    assert got == sorted((-1 if k == 30 else k, *x) for k, x in enumerate(brute(texts)))
    assert sum(x[2] for x in got) > 0


def test_the_sketch_adds_parts_cell_by_cell_and_never_counts_too_few(spark):
    rng = np.random.default_rng(5)
    sizes = B.Sizes(1 << 20, 0.02, 4 << 20, 0)
    parts = [rng.integers(0, 2**63, 3000, dtype=np.uint64) << np.uint64(1) for _ in range(6)]
    parts[3][:50] = parts[1][:50]
    mine = {"shard": [0] * 6, "cells": [], "many": []}
    cells = []
    for p in parts:
        distinct, n = np.unique(sizes.cells(p), return_counts=True)
        cells.append((distinct, n))
        mine["cells"].append(B.packed_deltas(distinct))
        mine["many"].append(np.packbits(n > 1).tobytes())
    total: Counter = Counter()
    for distinct, n in cells:
        total.update(dict(zip(distinct.tolist(), np.minimum(n, 2).tolist(), strict=True)))
    for (distinct, _), bits in zip(cells, B.merged_sketch(sizes)(mine), strict=True):
        assert np.unpackbits(np.frombuffer(bits, np.uint8), count=len(distinct)).tolist() == [total[c] > 1 for c in distinct.tolist()]


def test_words_that_collide_in_one_half_do_not_meet(spark, monkeypatch):
    """Whatever words the sketch's hash takes for equal, the grouping does not."""
    import xxhash

    a, b = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    real = xxhash.xxh3_128_digest
    monkeypatch.setattr(xxhash, "xxh3_128_digest", lambda w: bytes(8) + real(w)[8:])
    block = dedup.Block(pa.table({"doc_id": [1, 2], "text": [" ".join(a).encode(), " ".join(b).encode()], "block": [0, 0]}))
    sizes = B.Sizes(1 << 20, 0.02, 4 << 20, 2)
    pairs, count, _, _ = block.exact(np.r_[0:6, 40:46], sizes)
    assert pairs.shape[1] == 12 and (count == 1).all()


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**9)) for _ in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1000:1100]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in dedup.drop_repeated(docs).collect()} == {1: (300_000, 100), 2: (100, 100)}


def test_empty(spark):
    assert dedup.drop_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gram_hashes_and_deltas():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for k in (1, 2, 3, 18, 24, 35):
        once = B.gram_hashes(h, k)
        assert len(once) == 201 - k and all(B.gram_hashes(h[i : i + k], k)[0] == once[i] for i in range(0, 201 - k, 7))
    cells = np.sort(h)
    assert (B.unpacked_deltas(B.packed_deltas(cells)) == cells).all()
