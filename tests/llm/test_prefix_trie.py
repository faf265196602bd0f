import hashlib
import random
import zlib

from heronflow.llm import common, prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    said = {}
    for c, *turn in rows:
        if c is not None:
            said.setdefault(c, []).append(turn)
    own = {c: [(r or "", t or "") for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))] for c, ts in said.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for prefix in nodes:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)
    out = {}

    def below(prefix):
        parts = [below(k) for k in kids.get(prefix, [])]
        members = sorted(nodes[prefix])
        leaves = sum(p[0] for p in parts) or 1
        saved = sum(p[1] for p in parts) + ((len(members) - 1) * len(prefix[-1][1].encode()) if prefix else 0)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out[members[0], len(prefix)] = (parent, len(members), len(parts), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if nodes:
        below(())
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", depth int")
    out = T.prefix_trie(*T.spliced(T.ordered_turns(df)))
    assert out.columns == T.NODES
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in out.collect()}


def test_as_plain(spark):
    pick = random.Random(5)
    rows = [(c, t, pick.choice(["user", "assistant", None]), pick.choice(["a", "é", "", None])) for c in range(30) for t in range(pick.randrange(1, 14))]
    rows += [(c, None, "user", "a") for c in (3, 5)] + [(7, 1, "user", "b"), (7, 1, "user", "b"), (None, 0, "user", "x"), (101, 0, "user", "z" * 100_000)]
    rows += [(c, t, "user", "same") for c in (200, 205, 210) for t in range(20)]  # shared beyond one part of turns
    assert got(spark, rows) == plain_trie(rows)


def test_small(spark):
    assert got(spark, []) == {}
    one = [(10, 0, "user", "only")]
    assert got(spark, one) == plain_trie(one)
    gone = [(11, 0, "user", "turn that goes: its base is absent")]
    assert got(spark, gone) == plain_trie(gone)


def test_large_levels_and_pieces(spark, monkeypatch):
    """Levels that are not broadcast, and lists of ids in several pieces."""
    monkeypatch.setattr(T, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(T, "PIECE", 3)
    rows = [(c, t, "user", f"{c % 4 if t else 0}") for c in range(40) for t in range(3)]
    assert got(spark, rows) == plain_trie(rows)


def test_positions_of_a_group_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 2 as g", "id as v")
    places = common.positions(rows, "g", [rows.v.desc()], ["v"]).collect()
    assert {(r.g, r.v): r.pos for r in places} == {(v % 2, v): 499 - v // 2 for v in range(1000)}
