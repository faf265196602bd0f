import itertools
import math
import random

from heronflow.llm import decontaminate as d


def bm25(items):
    """Impacts by the formula, each item's summing to one."""
    split = [d.split_item(t)[0] for t in items]
    mean = sum(map(len, split)) / len(split)
    df = {w: sum(w in s for s in split) for s in split for w in s}
    out = []
    for s in split:
        mine = {}
        for w in set(s):
            tf = s.count(w)
            mine[w] = math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(s) / mean))
        total = sum(mine.values())
        out.append({w: x / total for w, x in mine.items()})
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 60 + [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [f"{text(rng.randrange(8, 50))}. {text(rng.randrange(1, 14))}." for _ in range(60)]
    docs = []
    for k in range(120):
        words = text(rng.randrange(400)).split()
        for item in rng.sample(items, k % 3):
            at = rng.randrange(len(words) + 1)
            said = item.upper() if k % 2 else item
            words[at:at] = (said if k % 5 else said.rsplit(". ", 1)[0]).split(" ")
        docs.append(" ".join(words))
    return items, docs


def test_search_retrieves_all_above_the_threshold(spark):
    items, docs = corpus()
    impact = bm25(items)
    rows = [(k, k, t) for k, t in enumerate(items)]
    got = d.impacts(d.item_words(spark.createDataFrame(rows, "key long, item_id long, text string"))).collect()
    assert all(abs(impact[r["key"]][r["word"]] - r["impact"]) < 1e-9 for r in got) and len(got) == sum(map(len, impact))
    index = d.Index(rows, [tuple(r) for r in got], 64)
    words = [d._words(t.lower()) for t in docs] + [[]]
    want = {
        (k, first, i)
        for k, ws in enumerate(words)
        for first in range(0, max(1, len(ws)), 64)
        for i in range(len(items))
        if sum(impact[i].get(w, 0) for w in set(ws[first : first + 128])) >= d.THRESHOLD
    }
    assert set(index.passages(words)) == want and len(want) > 50


def built(items, **over):
    rows = [(k, k, t) for k, t in enumerate(items)]
    return d.Index(rows, [(k, w, x) for k, mine in enumerate(bm25(items)) for w, x in mine.items()], over.get("stride", 64))


def test_blocks_are_skipped_and_work_comes_in_shares(monkeypatch):
    items, docs = corpus()
    words = [d._words(t.lower()) for t in docs]
    index = built(items)
    want = index.passages(words)
    passages = sum(max(1, -(-len(ws) // 64)) for ws in words)
    assert index.scored <= index.pivots < index.reached < passages * index.blocks
    assert index.scored < 0.8 * index.reached
    monkeypatch.setattr(d, "WORK", 50)
    assert sorted(built(items).passages(words)) == sorted(want)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    items, docs = corpus(5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    text = " ".join(docs)
    words = d._words(text.lower())
    monkeypatch.setattr(d, "SLICE", 3)
    found = list(d.pieces(text, 64))
    assert len(found) > 20 and max(map(len, found)) <= 4 * 64
    assert [w for p in found for w in p[: 3 * 64]] + found[-1][3 * 64 :] == words
    monkeypatch.undo()
    index = built(items)
    whole = {(first, i) for _, first, i in index.passages([words])}
    in_parts, start = set(), 0
    monkeypatch.setattr(d, "SLICE", 3)
    for piece in d.pieces(text, 64):
        in_parts |= {(start + first, i) for _, first, i in index.passages([piece])}
        start += 3 * 64
    assert whole == in_parts
    docs_of_one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert d.leaks(docs_of_one, bench).where("leaked").count() > 20


def test_memory_of_a_very_long_text():
    import tracemalloc

    items, docs = corpus(6)
    index = built(items)
    peaks = []
    for times in (40, 400):
        text = " ".join(docs * times)
        tracemalloc.start()
        n = sum(len(index.passages([p])) for p in d.pieces(text, index.stride))
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * len(text))
        tracemalloc.stop()
        assert n > 0
    assert len(d._words(text)) > 5_000_000 and peaks[1] < 1.5 * peaks[0] + (8 << 20)


def test_leaks_against_shingles(spark, monkeypatch):
    items, docs = corpus(4)
    bench = spark.createDataFrame([(k, t, "c") for k, t in enumerate(items)] + [(99, None, "c"), (98, "", "c")], "item_id long, text string, score string")
    table = spark.createDataFrame([(k, t, "c") for k, t in enumerate(docs)] + [(500, None, "c"), (501, "", "c"), (0, docs[0], "c")], "doc_id long, text string, item_id string")
    want = set()
    for k, t in enumerate(docs):
        mine = d.shingles(d._words(t.lower()))
        for i, item in enumerate(items):
            question, _, whole = map(d.shingles, d.split_item(item))
            if len(question & mine) >= 0.8 * len(question) or len(whole & mine) >= 0.8 * len(whole):
                want.add((k, i))
    assert {(r.doc_id, r.item_id) for r in d.leaks(table, bench).where("leaked").collect()} == want and len(want) > 90
    monkeypatch.setattr(d, "POSTINGS", 300)  # an index of several parts
    assert {(r.doc_id, r.item_id) for r in d.leaks(table, bench).where("leaked").collect()} == want
    assert {r.doc_id for r in d.without_leaks(table, bench).collect()} == {k for k in [*range(len(docs)), 500, 501] if k not in {a for a, _ in want}}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.leaks(docs, none).count() == 0
    assert d.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_least_score_is_that_of_the_worst_passage():
    rng = random.Random(6)
    for n in [*range(1, 24)] * 3:
        words = rng.choices([f"w{k}" for k in range(40)], k=n)
        impact = {w: rng.random() for w in set(words)}
        impact = {w: x / sum(impact.values()) for w, x in impact.items()}
        places = max(1, n - 4)
        said = [tuple(words[k : k + 5]) for k in range(places)]
        distinct = sorted(set(said))
        allowed = sum(k < 0.8 * len(distinct) for k in range(len(distinct) + 1))
        worst = min(
            sum(impact[w] for w in {w for s in kept for w in s})
            for m in range(allowed, len(distinct) + 1)
            for kept in itertools.combinations(distinct, m)
        )
        assert d.least_score(words, impact) <= worst + 1e-9
        if len(set(words)) == n:
            assert abs(d.least_score(words, impact) - worst) < 1e-9


def test_no_leak_is_missed_where_a_passage_starts_late_in_the_item(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices([f"w{k}" for k in range(300)], k=n))
    items = [f"{text(rng.randrange(5, 10))}. {text(rng.randrange(14, 50))}." for _ in range(40)]
    docs = []
    for item in items:
        words = item.split(" ")
        docs += [f"{text(40)} {' '.join(words[k:])} {text(90)}" for k in range(3, 10)]
    want = set()
    for k, t in enumerate(docs):
        words = d._words(t.lower())
        passages = [d.shingles(words[first : first + 128]) for first in range(0, len(words), 64)]
        for i, item in enumerate(items):
            question, _, whole = map(d.shingles, d.split_item(item))
            if any(len(s & mine) >= 0.8 * len(s) for s in (question, whole) for mine in passages):
                want.add((k, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.leaks(table, bench).where("leaked").collect()} == want and len(want) > 60
