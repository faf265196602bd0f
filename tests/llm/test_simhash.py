import random
import tempfile

import numpy as np
from pyspark.sql import Row

from heronflow.llm import simhash


def brute(rows):
    """Fingerprints by counting bits, components by union of all pairs."""
    import re

    import xxhash

    fps = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[key] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    of = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b])
                    changed = True
    return {(k, f"{fps[k]:016x}", of[k]) for k in fps}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "ONE  two\n"), (4, "a b c d"), (5, "Üb ñ " * 3)]
    for k in range(6, 120):
        if k % 3 and k > 10:
            old = rows[rng.randrange(6, k)][1].split()
            old[rng.randrange(len(old))] = rng.choice(words)
            rows.append((k, " ".join(old)))
        else:
            rows.append((k, " ".join(rng.choices(words, k=rng.randrange(80, 300)))))
    docs = spark.createDataFrame([Row(doc_id=k, text=t, fp="x", lang=None) for k, t in rows], "doc_id long, text string, fp string, lang string")
    got = {(r.doc_id, f"{r.fp & 2**64 - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_no_pair_is_lost():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    fps = np.unique(np.r_[base, near])
    anchor, row, home = simhash.anchors(fps)
    assert home.sum() == 3 * len(fps)
    found = {tuple(x) for x in simhash.links(anchor, fps[row], home).tolist()}
    want = {(max(a, b), min(a, b)) for a, b in zip(base.tolist(), near.tolist(), strict=True) if a != b}
    assert want <= found


def test_large_groups_are_connected_without_all_pairs():
    rng = np.random.default_rng(4)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    anchor, row, home = simhash.anchors(fps)
    assert len(simhash.links(np.zeros(len(fps), np.int64), fps, np.ones(len(fps), bool))) == len(fps) - 1


def test_empty_and_keep_one(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (None, "a b c d e", "z"), (7, "other words in this text", None)], schema)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(docs).collect()) == [(False, 1), (False, 7), (True, 0)]


def test_very_long_texts(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " x"), (3, "a b"), (4, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.mode("overwrite").parquet(f"{(folder := tempfile.mkdtemp())}/documents.parquet")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, folder).collect()}
    assert got == brute(rows)
