import random

import pytest

import corpus_pipeline
from heronflow.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components of all pairs by sets of shingles."""
    held = {k: sets(t) for k, t in rows}
    of = {k: k for k in held}
    for a in held:
        for b in held:
            both = len(held[a] & held[b])
            if a < b and (both >= 0.8 * (len(held[a]) + len(held[b]) - both)):
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    return of


def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    passage = rng.choices(words, k=60)
    rows = [(0, ""), (1, None), (2, "One two"), (3, "one  TWO"), (4, "a b c d e")]
    for k in range(5, 150):
        new = rng.choices(words, k=rng.randrange(60, 300))
        if k % 3 and k > 10:
            new = (rows[rng.randrange(5, k)][1] or "x").split()
            for _ in range(rng.randrange(1, 9)):
                new[rng.randrange(len(new))] = rng.choice(words)
        elif k % 4 == 0:
            new[10:10] = passage
        rows.append((k, " ".join(new)))
    return rows


@pytest.mark.parametrize("big", [512, 3])
def test_against_all_pairs(spark, monkeypatch, big):
    monkeypatch.setattr(near_copies, "BIG", big)
    monkeypatch.setattr(near_copies, "PIVOTS", 1 if big == 3 else 32)
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)).collect()}
    assert got == want and 20 < len(set(want.values())) < len(want)


def test_the_stage_drops_copies_that_four_bits_keep_apart(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(*r, None) for r in rows] + [(None, rows[9][1], None)], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).where("doc_id is not null").collect())
    want = brute(rows)
    assert got == sorted(set(want.values()))
    assert simhash.keep_one(docs).count() > len(got) + 1


def test_a_large_group_costs_few_edges_and_no_link_is_lost():
    a = near_copies.shingle_set(" ".join(f"w{k}" for k in range(200)))
    many = [a[k:] for k in range(60)]
    assert len(near_copies.spanning(list(range(60)), many)) == 59
    assert near_copies.spanning([1, 2], [a, a[60:]]) == []


def test_the_stage_goes_through_simhash(spark, monkeypatch):
    """Its groups are op8's components, of nodes; the stage asks for them."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    found = spark.createDataFrame([(near_copies.node(near_copies.shingle_set(t or "")) - 2**63, simhash.fingerprint(t or "") - 2**63) for _, t in rows], "node long, fp long")
    groups = {}
    for r in near_copies.simhash_groups(found).distinct().collect():
        groups.setdefault(r["key"], set()).add(r["node"])
    node_of = {k: near_copies.node(near_copies.shingle_set(t or "")) - 2**63 for k, t in rows}
    want = {}
    for r in simhash.near_duplicates(docs).collect():
        want.setdefault(r["component_id"], set()).add(node_of[r["doc_id"]])
    several = [g for g in want.values() if len(g) > 1]
    assert len(several) > 5 and sorted(map(sorted, several)) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    asked, real = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: asked.append(a) or real(*a))
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == len(set(brute(rows).values()))
    assert len(asked) == 1
