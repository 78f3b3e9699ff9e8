"""Models grown on counted cells are those that the estimator fits on the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcraft.plans import sweep as SW
from foldcraft.plans import train as TR
from foldcraft.session import cut_lineage

SETS = {"one": ["a"], "both": ["a", "b"]}
PLAIN = ["x", "z"]


def counted(rows):
    return {(r.y, round(r.score, 9)): r.n for r in rows.groupBy("y", "score").agg(F.sum("n").alias("n")).collect()}


def encoded_rows(spark, seed, odd):
    """Rows encoded for two folds; ``odd``: absent categories, tied and negative numbers, repeated rows."""
    r, rows = random.Random(seed), []
    for i in range(900):
        a, b = r.choice("abcdefg"), r.choice("uvw")
        x, z = r.gauss(0, 3), float(r.randrange(5))
        y = int(x + "abcdefg".index(a) + 3 * (b == "w") + r.gauss(0, 4) > 3)
        if odd:
            a, x, z = (None if r.random() < 0.1 else a), float(round(x)), -z
        own = r.randrange(2)
        for f in (0, 1):
            te = [(hash_of(v, m, f)) for m in (1, 2) for v in (a, b)]
            rows += [(i, f, "valid" if f == own else "fit", y, a, b, x, z, *te)] * (1 + (odd and i % 7 == 0))
    names = [f"te_m{m}_{c} double" for m in (1, 2) for c in "ab"]
    d = spark.createDataFrame(rows, f"id long, fold long, part string, y int, a string, b string, x double, z double, {', '.join(names)}")
    return cut_lineage(d.repartition(3, "id"), "sweep-test")


def hash_of(v, m, f):
    """An encoding: two categories may share one under one smoothing only."""
    return 0.5 if v is None else ((ord(v) * (m + 2) + f) % (5 if m == 1 else 11)) / 7


@pytest.mark.parametrize("odd", [False, True])
def test_models_are_the_estimators(spark, odd):
    rows = encoded_rows(spark, 5, odd)
    est = TR.gbt("y", 4, 3, 0.3)
    got = SW.sweep_scores(rows, SETS, ["m1", "m2"], PLAIN, "y", [0, 1], est)
    for enc, name, keep, f in (("m1", "one", 0, 0), ("m2", "both", 0, 1), ("m1", "both", 1, 0), ("m2", "both", 1, 1), ("m2", "one", 1, 0)):
        features = [f"te_{enc}_{c}" for c in SETS[name]] + PLAIN * keep
        own = rows.filter(F.col("fold") == f)
        model = TR._fit(own.filter("part = 'fit'").select("y", *features), TR._stages(features, False), lambda: est, "y", None)
        want = TR._prob(model.transform(own.filter("part = 'valid'"))).select("y", "score", F.lit(1.0).alias("n"))
        assert counted(got.filter((F.col("encoding") == enc) & (F.col("name") == name) & (F.col("keep") == keep) & (F.col("fold") == f))) == counted(want)


def test_rows_are_counted_once(spark):
    """No model reads rows: cells carry every row, and each tree's subsample."""
    rows = encoded_rows(spark, 6, True).withColumn("x", F.col("z"))
    est = TR.gbt("y", 4, 3, 0.3)
    cells, points = SW.count_cells(rows, SETS, ["m1", "m2"], ["x"], "y", [0, 1], est)
    n = {(r.name, r.keep, r.fold, r.part): r for r in cells.groupBy("name", "keep", "fold", "part").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), *[F.sum(f"bag_{t}").alias(f"bag_{t}") for t in range(4)]).collect()}
    for r in rows.groupBy("fold", "part").count().collect():
        for name in SETS:
            for keep in (0, 1):
                c = n[name, keep, r.fold, r.part]
                assert c.n == r["count"] and c.cells < c.n
                assert all(0.7 * c.n < c[f"bag_{t}"] < 0.9 * c.n for t in range(4)) == (r.part == "fit")
    assert len(points[0, "x"]) == 4  # between -4 to 0


@pytest.mark.parametrize("x", [None, float("nan"), float("inf")])
def test_no_number(spark, x):
    """The estimator takes finite numbers only."""
    rows = encoded_rows(spark, 7, False).withColumn("x", F.when(F.col("id") == 5, F.lit(x)).otherwise(F.col("x")))
    with pytest.raises(Exception, match="x has values that are NaN"):
        SW.sweep_scores(rows, SETS, ["m1", "m2"], PLAIN, "y", [0, 1], TR.gbt("y", 4, 3, 0.3))


def test_thresholds_of_many_values(spark):
    """Equal frequencies as the estimator's walk takes them, heavy values too."""
    r = np.random.default_rng(3)
    values = np.concatenate([np.round(r.normal(0, 20, 3000), 1), np.full(900, 2.5), np.full(400, 2.6)])
    seen, c = np.unique(values, return_counts=True)
    hist = spark.createDataFrame([(0, "x", float(v), int(k)) for v, k in zip(seen, c)], "fold int, feature string, value double, c long")
    want, target, at = [], len(values) / 32, c[0]
    for i in range(1, len(seen)):
        if abs(at - target) < abs(at + c[i] - target):
            want.append((seen[i - 1] + seen[i]) / 2)
            target += len(values) / 32
        at += c[i]
    assert SW.split_points(hist, 32)[0, "x"].tolist() == want and 20 < len(want) < 32
