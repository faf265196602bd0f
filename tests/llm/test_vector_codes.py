import numpy as np
import pytest

from heronflow.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain_codes(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """Every distance of every entry."""
    numbers = V.cut(V.whole_numbers(np.array([r[1] for r in rows])), parts)
    books = [numbers[:entries, p].copy() for p in range(parts)]

    def nearest():
        d = [((numbers[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return np.stack([x.argmin(axis=1) for x in d], axis=1), sum(x.min(axis=1) for x in d)

    for _ in range(rounds):
        codes, _ = nearest()
        for p in range(parts):
            for e in set(codes[:, p].tolist()):
                books[p][e] = numbers[codes[:, p] == e, p].sum(axis=0) // (codes[:, p] == e).sum()
    return (*nearest(), books)


@pytest.mark.parametrize(("n", "width"), [(700, 8), (5, 8), (300, 10)])
def test_as_every_distance(spark, n, width):
    make = np.random.default_rng(3)
    values = np.round(make.normal(size=(n, width)) / 4, 2).astype(np.float32)  # rounded: ties
    values[n // 2 :: 3] = values[0]  # repeated rows
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(values)]
    books, size = V.fit(spark.createDataFrame(rows, SCHEMA))
    codes, errors, want = plain_codes(rows)
    assert size == width and V.digest(books) == V.digest(want)
    got = {r.vec_id: (r.code, r.error) for r in V.encode(spark.createDataFrame(rows, SCHEMA), books, size).collect()}
    assert got == {k: (codes[k].tolist(), int(errors[k])) for k in range(n)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [1.0, 2.0, 3.0, 4.0], None), (2, [0.0] * 4, None), (3, [nan, 0.0, 0.0, 0.0], 1), (5, [inf, 0.0, 0.0, 0.0], 1), (6, None, 1), (7, [1.0, None, 1.0, 1.0], 1), (8, [1.0, 2.0], 2), (None, [1e30, -1e30, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", code string")
    books, n = V.fit(df)
    assert n == 4 and [len(b) for b in books] == [3] * 4
    got = {r.vec_id: (r.code, r.error, r.label) for r in V.encode(df, books, n).collect()}
    assert got == {4: ([1, 1, 1, 1], 0, None), 2: ([0, 0, 0, 0], 0, None), 8: (None, None, 2), None: ([2, 2, 0, 0], 0, 2)}
    back = {r.vec_id: r.vector for r in V.decoded(V.encode(df, books, n), books, n).collect()}
    assert back[4] == [1.0, 2.0, 3.0, 4.0] and back[8] is None
    empty = df.where("vec_id > 100")
    assert V.encode(empty, *V.fit(empty)).collect() == []
    hollow = spark.createDataFrame([(1, [], 0)], SCHEMA)
    assert [r.error for r in V.encode(hollow, *V.fit(hollow)).collect()] == [0]
