import re
from collections import Counter

import duckdb

from heronflow.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, source string, host string, Kept string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n\n \nx", "é# *ñ $%&|<>", "a b c d a b c e b c d", "w " * 5000, "\x85 \xa0 a"]
    docs = spark.createDataFrame([(k, t, "s", "clash", "clash") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in rules.COUNTS) for r in rules.quality_rules(docs).collect()}
    for k, t in enumerate(texts):
        n, chars, symbols, lines, repeated = brute(t)
        assert got[k] == (n, chars, symbols, lines, repeated), t


CLEAN = " ".join(f"w{k}" for k in range(80))


def mixed_hosts():
    """A host of which half fails, and good ones; each has a document of 20 and
    one of 33 symbols a hundred words, and a clean one."""
    cases = {0: CLEAN, 1: CLEAN + " #" * 20, 2: CLEAN + " #" * 40}
    rows = []
    for h, host in enumerate(["bad", "good0", "good1", "good2", None]):
        rows += [(1000 * h + k, t, host, "h", "k") for k, t in cases.items()]
        rows += [(1000 * h + 10 + k, CLEAN + (" #" * 300 if host == "bad" and k % 2 else ""), host, "h", "k") for k in range(60)]
    return rows + [(9000, "short", None, "h", "k")]


def test_hosts_decide(spark):
    ruled = rules.quality_rules(spark.createDataFrame(mixed_hosts(), SCHEMA))
    got = {r.doc_id: (r.base_failed, r.kept, r.suspect) for r in ruled.collect()}
    assert [got[k] for k in (0, 1, 2)] == [(False, True, False), (False, False, False), (False, False, True)]
    for h in (1, 2, 3, 4):
        assert [got[1000 * h + k] for k in (0, 1, 2)] == [(False, True, False), (False, True, False), (False, True, True)]
    assert got[9000] == (True, False, True) and all(kept for k, (_, kept, suspect) in got.items() if not suspect and k != 1)
    strict = {r.source: r for r in ruled.select("source", *rules.STRICT).distinct().collect()}
    assert strict["bad"].strictness_symbols == 2 and all(r.strictness_symbols == 0.5 for h, r in strict.items() if h != "bad")
    assert all(r.strictness_dup_lines == 1 for r in strict.values())


def hosts_bad_in_one_rule():
    """A host of which half has too many symbols, one of which half has repeated
    lines, one of short texts, and good ones; each has a document with a few
    symbols, one with some repeated lines and a clean one."""
    many = CLEAN + "\n" + "\n".join(["again"] * 20)
    lines = CLEAN + "\n" + "\n".join(["one", "one", "two", "two", "three"])  # 2 of 6
    bad = {"signs": " ".join([CLEAN, *(f"#{k}" for k in range(300))]), "lines": many, "short": "few words"}
    rows = []
    for h, host in enumerate([*bad, "good0", "good1", None]):
        rows += [(1000 * h + k, t, host, "h", "k") for k, t in enumerate([CLEAN, CLEAN + " #" * 20, lines])]
        rows += [(1000 * h + 10 + k, bad.get(host, CLEAN) if k % 2 else CLEAN, host, "h", "k") for k in range(80)]
    return rows


def test_each_rule_has_a_strictness_of_its_own(spark):
    ruled = rules.quality_rules(spark.createDataFrame(hosts_bad_in_one_rule(), SCHEMA))
    got = {r.doc_id: r.kept for r in ruled.collect()}
    kept = [[got[1000 * h + k] for k in range(3)] for h in range(6)]
    # Bad by symbols, bad by lines, bad by base rules, good ones.
    assert kept == [[True, False, True], [True, True, False], [True, False, False], *[[True, True, True]] * 3]


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(mixed_hosts(), SCHEMA)
    want = sorted((r.doc_id, r.kept) for r in rules.quality_rules(docs).collect())
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 1)
    for hot in (2_000, 4):
        monkeypatch.setattr(rules, "HOT_HOSTS", hot)
        assert sorted((r.doc_id, r.kept) for r in rules.quality_rules(docs).collect()) == want


def test_sql_gives_the_same(spark, tmp_path):
    db = duckdb.connect()
    for name, rows in {"mixed": mixed_hosts(), "by_rule": hosts_bad_in_one_rule(), "alike": [(k, CLEAN + " #" * (40 * (k % 3)), f"h{k % 2}", "h", "k") for k in range(60)]}.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        db.execute(f"CREATE OR REPLACE VIEW documents AS FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        got = rules.op5_quality_rules(spark, f"{tmp_path}/{name}")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({rules.SQL}) ORDER BY doc_id").fetchall()
        assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want


def test_clashing_columns_and_a_long_text(spark):
    text = "a b c d " * 300_000
    docs = spark.createDataFrame([(1, text, "s", 7, "x")], "doc_id long, text string, source string, _words int, _lines string")
    (r,) = rules.quality_rules(docs).collect()
    assert (r._words, r._lines, r.n_words, r.n_repeat_words, r.base_failed) == (7, "x", 1_200_000, 1_200_000, True)


def test_empty(spark):
    assert rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
