import random

import pytest

from heronflow.llm import components as c


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root}


def graphs():
    rng = random.Random(3)
    star = [(500, k) for k in range(400)] + [(k, 1000 + k) for k in range(50)]
    chain = [(k, k + 1) for k in range(60)] + [(100, 60)]
    sparse = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    return {"star": star, "small hub": [(-1, k) for k in range(300)], "chain": chain, "sparse": sparse, "odd": [(1, 1), (2, None), (None, None), (4, 3), (3, 4), (4, 3)], "none": []}


@pytest.mark.parametrize("hubs", [4000, 10])
def test_against_union_find(spark, monkeypatch, hubs):
    monkeypatch.setattr(c, "HUBS", hubs)
    for name, edges in graphs().items():
        got = [(r.u, r.root) for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()]
        assert set(got) == brute(edges) and len(got) == len(set(got)), name


def test_few_edges_make_few_files(spark, tmp_path):
    """Rounds on 300 edges once wrote a file for each of 64 partitions, several times a round."""
    context = spark.sparkContext._jsc.sc()
    before = context.getCheckpointDir()
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = c.components(spark.createDataFrame([(k, k + 1) for k in range(300)], "u bigint, v bigint").coalesce(1)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        if before.isDefined():
            spark.sparkContext.setCheckpointDir(before.get())
    assert sorted(map(tuple, rows)) == [(k, 0) for k in range(301)]
    # 64 of the edges as they come; then two tables a round.
    assert len(list(tmp_path.rglob("part-*"))) < 64 + 40
