"""Grid search, saved preprocessors, detected categories, hash-drawn forests."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from heronflow.ml import boost, ensemble, forest, preprocess, search


def labelled(spark, n=900):
    make = np.random.default_rng(5)
    x = make.normal(size=(n, 2))
    odd = np.arange(n) % 10 == 0
    x[odd] += 6
    return spark.createDataFrame([(k, float(a), float(b), int(o)) for k, ((a, b), o) in enumerate(zip(x, odd, strict=True))], "id bigint, a double, b double, label int").repartition(5)


def test_grid_search_is_the_sequential_one(spark):
    df = labelled(spark)
    parameters = search.grid(trees=[5, 20], sample=[32, 128], contamination=[0.03, 0.1])
    assert len(parameters) == 8 and parameters[1] == {"trees": 5, "sample": 32, "contamination": 0.1}
    out = search.search(df, "id", ["a", "b"], "label", parameters, search.fit_forest, search.predict_forest)
    got = {r.p: (r.tp, r.fp, r.fn, r.tn) for r in out.collect()}
    rows = df.withColumn("fold", search._fold("id", 3)).toPandas().sort_values("id")
    x, y, fold = rows[["a", "b"]].to_numpy(), rows["label"].to_numpy(), rows["fold"].to_numpy()
    want = {}
    for p, values in enumerate(parameters):
        said = np.zeros(len(x), int)
        for f in range(3):
            said[fold == f] = search.predict_forest(search.fit_forest(x[fold != f], y[fold != f], **values), x[fold == f])
        want[p] = tuple(int(((said == s) & (y == t)).sum()) for s, t in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert got == want
    f1 = {p: 2 * tp / max(1, 2 * tp + fp + fn) for p, (tp, fp, fn, _) in want.items()}
    top = max(f1, key=lambda p: (f1[p], -p))
    assert search.best(out, parameters) == (parameters[top], f1[top]) and f1[top] > 0.8


def test_preprocessor_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (None, 5.0, None), (10.0, 5.0, None)], "a double, same double, none double")
    for kind in ("robust", "standard", "minmax"):
        preprocess.Preprocessor.fit(df, df.columns, kind).save(spark, str(tmp_path / kind))
        back = preprocess.Preprocessor.load(spark, str(tmp_path / kind))
        rows = [tuple(r) for r in back.transform(df).collect()]
        assert [r[1] for r in rows] == [0.0] * 4 and [r[2] for r in rows] == [0.0] * 4
        centre, span = {"robust": (2.0, 4.5), "standard": (13 / 3, np.std([1, 2, 10])), "minmax": (1.0, 9.0)}[kind]
        assert np.allclose([r[0] for r in rows], [(v - centre) / span for v in (1, 2, 2, 10)])


def test_categories_are_found(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 5 as int) as few", "cast(id % 2 as string) as text", "id % 3 = 0 as flag", "cast(id as double) / 7 as real", "cast(id % 5 >= 3 as double) as label")
    assert preprocess.categorical_columns(df, ["id", "few", "text", "flag", "real"], 50) == ["few", "text", "flag"]
    assert preprocess.categorical_columns(df, ["real", "few", "text"]) == ["text"]
    model = boost.boosted(df, ["few", "text", "flag", "real"], "label", rounds=3, depth=2)
    out = boost.probability(model, df)
    assert out.columns == [*df.columns, "score"] and dict(out.dtypes)["few"] == "int"
    means = {r.label: r.m for r in out.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1.0] > means[0.0] + 0.3
    assert boost.probability(model, df.limit(1).withColumn("text", F.lit("never seen"))).count() == 1


def test_boosting_works_its_rows_out_once(spark):
    """Rows alike are fitted as one, by weight; a label's share decides, not how many kinds of rows there are."""
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(4000, numPartitions=2).selectExpr("cast(id % 4 as int) as x", "cast(id % 400 < 300 as string) as c", "cast(if(id % 4 = 3, id % 40 <> 3, id % 40 = 0) as double) as y")
    model = boost.boosted(df.mapInArrow(told, df.schema), ["x"], "y", ["c"], rounds=5, depth=2)
    assert read.value == 4000
    means = {r.x: r.m for r in boost.probability(model, df).groupBy("x").agg(F.avg("score").alias("m")).collect()}
    assert means[3] > 0.6 and max(means[k] for k in (0, 1, 2)) < 0.4


def test_hash_forest(spark):
    df = labelled(spark)
    nodes = forest.fit_by_hash(df, "id", ["a", "b"], trees=12, sample=64)
    again = forest.fit_by_hash(df.repartition(2), "id", ["a", "b"], trees=12, sample=64)
    key = ["tree", "node"]
    pd.testing.assert_frame_equal(nodes.toPandas().sort_values(key, ignore_index=True), again.toPandas().sort_values(key, ignore_index=True))
    scored = forest.score(df, ["a", "b"], nodes)
    means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("anomaly_score").alias("m")).collect()}
    assert means[1] > means[0]
    made = ensemble.forests(df, "id", ["a", "b"], trees=4)
    roots = [m[2].where("node = 1").agg(F.avg("size")).first()[0] for m in made]
    assert roots[3] > roots[4] * 1.2  # shares of the rows: 0.9 and 0.5


def test_quantiles_shuffle_only_the_parts_asked_for(spark, monkeypatch):
    from heronflow.operators import quantiles

    seen = []
    real = quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda df: seen.append(df.columns) or real(df))
    rows = [(float(k), None if k % 3 else float(k % 50), None, "w" * 50) for k in range(4001)]
    df = spark.createDataFrame(rows, "a double, `b.c` double, none double, wide string")
    got = quantiles.exact_quantiles(df, ["a", "b.c", "none"], [0.0, 0.3, 0.5, 1.0])
    assert got["a"] == {0.0: 0.0, 0.3: 1200.0, 0.5: 2000.0, 1.0: 4000.0} and set(got["none"].values()) == {None}
    mine = sorted(b for _, b, *_ in rows if b is not None)
    assert got["b.c"][0.5] == mine[(len(mine) - 1) // 2] / 2 + mine[len(mine) // 2] / 2
    assert seen == [["a", "b.c", "none"]]  # the join or file behind is read once, and no other column
    assert quantiles.exact_quantiles(df.where("false"), ["a"], [0.5]) == {"a": {0.5: None}}


def test_forest_walks_all_rows_level_by_level():
    import numpy as np
    import pandas as pd

    from heronflow.ml import forest

    x = np.random.default_rng(3).normal(size=(300, 3))
    nodes = pd.DataFrame([n for t in range(4) for n in forest.grow_by_hash(x[:64], t, 64, 42)], columns=["tree", "node", "feature", "threshold", "size"])
    total = np.zeros(len(x))
    for _, part in nodes.groupby("tree"):
        held = part.set_index("node").to_dict("index")
        for k, row in enumerate(x):
            at, depth = 1, 0
            while held[at]["feature"] >= 0:
                at, depth = 2 * at + int(row[held[at]["feature"]] > held[at]["threshold"]), depth + 1
            total[k] += (depth + float(forest.average_path(held[at]["size"]))) / float(forest.average_path(held[1]["size"]))
    made = forest.Forest(nodes)
    assert np.allclose(made.scores(x), 2 ** (-total / 4))
    assert max(len(path) for *_, path, _ in made.trees) < 128  # nodes that there are, not 2 ** depth
