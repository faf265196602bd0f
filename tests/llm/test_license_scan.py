import random
import re

import duckdb

from heronflow.llm import license_scan as scan

SCHEMA = "doc_id long, text string, n_words string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    mine = words(text)
    places = [(i, label) for p, label in scan.PHRASES.items() for i in range(len(mine)) if mine[i : i + len(p.split())] == p.split()]
    found, held = set(), {}
    for label, t in scan.TEMPLATES:
        want, size = set(words(t)), 8
        while size < len(words(t)):
            size *= 2
        for start in range(0, len(mine), size):
            block = mine[start : start + 2 * size]
            both = len(want & set(block))
            if both >= scan.CONTAINMENT * len(want):
                held.setdefault((start, size), []).append((label, want, len(block), both / len(want)))
    for (start, _), some in held.items():
        for label, want, n, share in some:
            if not any(other != label and more > share and len(want & theirs) >= scan.CONTAINMENT * len(want) for other, theirs, _, more in some):
                found.add((label, start, n, share))
    starts = [i for i, _ in places]
    return len(mine), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), found


def corpus(seed=1):
    rng = random.Random(seed)
    pool = [w for _, t in scan.TEMPLATES for w in t.split()] + ["CC", "by", "all", "rights", "Reserved", "General-Public", "License", "é", "x9"]
    texts = [None, "", "\n\n", "CC BY", "cc by cc by", "ccby", "CC\nBY-NC", "all rights reserved all rights reserved", "ÉCC BY", "cc by\x80"]
    texts += [rng.choice(["", "word ", "(c) "]) + t + rng.choice(["", ".", " more\nlines"]) for _, t in scan.TEMPLATES]
    for _, t in scan.TEMPLATES:  # wrapped, some words lost, in the middle of other text
        kept = [w for w in t.split() if rng.random() > 0.08]
        wrapped = " ".join(w + ("\n#" if k % 9 == 8 else "") for k, w in enumerate(kept))
        texts.append("lorem " * rng.randrange(200) + wrapped + " ipsum" * rng.randrange(50))
    return texts + ["".join(rng.choice(pool) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randrange(150))) for _ in range(300)]


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in scan.scan_licenses(docs).collect()}
    hits = 0
    for k, t in enumerate(texts):
        r = got[k]
        found = {(f.label, f.start, f.n_words, f.containment) for f in r.found}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, found) == brute(t), t
        hits += len(found)
    assert hits > 60


def test_wrapped_notices_are_found(spark):
    texts = ["lorem " * 37 + t.replace(" ", "\n * ", 3) + " ipsum" * 90 for _, t in scan.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan.scan_licenses(docs).collect():
        assert scan.TEMPLATES[r.doc_id][0] in {f.label for f in r.found}


def test_each_filter_rejects_pairs():
    texts = [words(t) for t in corpus(2)]
    counts = {w: sum(w in t for t in map(set, texts)) for w in {w.encode() for _, t in scan.TEMPLATES for w in words(t)}}
    counts = {w: sum(w.decode() in t for t in map(set, texts)) for w in counts}
    known = scan.Templates(scan.TEMPLATES, counts, scan.CONTAINMENT)
    found = sum(len(known.scan([w.encode() for w in t])) for t in texts)
    assert found <= known.placed < known.long_enough < known.met


def test_sql_gives_the_same(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(corpus(3))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = scan.op6_license_scan(spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({scan.SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want


def test_licenses_that_differ_in_a_word_are_told_apart(spark):
    cut = "lorem ipsum licensed as of now under CC BY SA in version 4 dolor"  # a word short: still the nearest
    (r,) = scan.scan_licenses(spark.createDataFrame([(1, cut)], "doc_id long, text string")).collect()
    assert {(f.label, round(f.containment, 3)) for f in r.found} == {("cc-by-sa", 0.857)}
    texts = ["Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0", "Licensed under\nCC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {f.label for f in r.found} | set(r.base_labels) for r in scan.scan_licenses(docs).collect()}
    assert got == {0: {"cc-by"}, 1: {"cc-by", "cc-by-nc"}, 2: {"cc-by", "cc-by-sa"}, 3: {"cc-by"}}


def test_a_very_long_text(spark):
    text = "a license of b " * 300_000 + "Released\nunder the MIT\nLicense."
    (r,) = scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_words == 1_200_005 and "mit" in {f.label for f in r.found}


def test_empty_and_repeated_rows(spark):
    assert scan.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "CC BY", "a"), (None, "CC BY", "a")], SCHEMA)
    assert [r.n_base for r in scan.scan_licenses(docs).collect()] == [1, 1]
