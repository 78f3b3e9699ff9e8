"""Edge cases on hand tables (expected values from pandas semantics)."""

from pyspark.sql import functions as F

from foldcraft.operators import binning as H
from foldcraft.operators import folds as K
from foldcraft.operators import rank as G
from foldcraft.operators import encode as E
from foldcraft.operators.prefix import row_number_by_value


def test_right_closed_codes(spark):
    df = spark.createDataFrame([(0.0,), (6.0,), (7.0,), (100.0,), (101.0,)], ["x"])
    edges = [0, 6, 12, 24, 100]
    got = df.select(H.right_closed_code(F.col("x"), edges, include_lowest=False).alias("a"),
                    H.right_closed_code(F.col("x"), edges, include_lowest=True).alias("b")).collect()
    assert [r.a for r in got] == [-1, 0, 1, 3, -1]
    assert [r.b for r in got] == [0, 0, 1, 3, -1]


def test_quartile_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 4, 4, 9]], ["x"])
    assert H.quantile_edges(df, "x", 4) == [1.0, 2.5, 4.0, 9.0]


def test_average_tie_pct_rank(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 5])], ["id", "x"])
    got = G.pct_rank(df, ["x"]).orderBy("id").collect()
    assert [r.rank_x for r in got] == [0.375, 0.375, 0.75, 1.0]


def test_five_way_split_of_13(spark):
    df = spark.createDataFrame([(i,) for i in range(13)], ["id"])
    p = K.near_equal_parts(df, 5, "id").groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in p] == [3, 3, 3, 2, 2]


def test_row_number_by_value_is_exact(spark):
    vals = [5, 3, 3, 9, 1, 7, 7, 7, 2]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], ["id", "x"])
    got = row_number_by_value(df, "x", tiebreak="id", n_buckets=3).orderBy("rn").collect()
    assert [r.id for r in got] == sorted(range(len(vals)), key=lambda i: (vals[i], i))


def test_smoothed_encoding_unseen_gets_prior(spark):
    fit = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], ["c", "y"])
    rows = spark.createDataFrame([("a",), ("z",)], ["c"])
    out = {r.c: r.te_c for r in E.encode_full(fit, rows, ["c"], {"te": E.smoothed(1)}).collect()}
    prior = 2 / 3
    assert abs(out["a"] - (1 + prior) / 3) < 1e-12
    assert abs(out["z"] - prior) < 1e-12


def test_label_stats_std_min_max(spark):
    n, s = F.lit(4.0), F.lit(1.0)
    r = spark.range(1).select(E.label_std(n, s, None, None).alias("sd"), E.label_min(n, s, None, None).alias("mn"),
                              E.label_max(n, s, None, None).alias("mx")).first()
    assert abs(r.sd - 0.5) < 1e-12 and r.mn == 0.0 and r.mx == 1.0


def test_weight_grid_values():
    from foldcraft.plans.catalog import GRID
    assert GRID == [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75]


def test_features_on_rows_the_schema_allows(spark):
    """Negative totals, a month count of -1, denominators of zero: no feature raises."""
    from foldcraft.functions import scalar as S
    row = {c: "No" for c in S.SERVICES} | {"pri": "1-URGENT", "seg": "AUTOMOBILE", "nation": "N", "region": "R", "n_items": 0}
    rows = [row | dict(tenure=t, monthly=m, total=x) for t, m, x in (
        (-1, 5.0, -1234.5), (0, -1.0, -1.0), (3, -0.01, -1e-6), (3, 0.0, 0.0), (None, None, None))]
    d = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in (*S.SERVICES, "pri", "seg", "nation", "region"))
                              + ", n_items bigint, tenure int, monthly double, total double")
    got = d.select(*[S.spark_out(f) for f in S.feature_set("full")]).collect()
    assert [r.tc_first_digit for r in got] == [1, 1, 0, 0, None]
    assert got[0].avg_monthly_charges is None and got[2].charge_intensity is None and got[2].actual_months is None
    assert [r.charge_stability for r in got[:2]] == [round(1229.5 / -1233.5, 6), None]
    assert [r.tc_dev_from_round100 for r in got[:2]] == [34.5, 1.0]


def test_nan_is_no_score(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (float("nan"), 0), (None, 1)], "s double, y int")
    assert G.auc(df, "s", "y").first()[:] == (1.0, 1.0, 1.0)
    q = G.exact_quantiles(df, "s", [0.0, 0.5, 1.0]).orderBy("p").collect()
    assert [round(r.q, 9) for r in q] == [0.1, 0.5, 0.9]


def test_many_quantiles_like_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(s, float(v)) for s, n in (("a", 500), ("b", 3), (None, 40)) for v in rng.integers(-20, 20, n) / 4]
    probs = [i / 137 for i in range(138)]
    df = spark.createDataFrame(rows, "s string, x double")
    got = {(r.s, r.p): r.q for r in G.exact_quantiles(df, "x", probs, ["s"]).collect()}
    assert len(got) == 3 * 138
    for s in ("a", "b", None):
        want = np.quantile([v for t, v in rows if t == s], probs)
        assert np.allclose([got[s, p] for p in probs], want, atol=1e-12)
    assert G.exact_quantiles(df.limit(0), "x", probs, ["s"]).collect() == []


def test_codes_by_binary_search(spark):
    edges = [-3.0, -0.5, 0.0, 2.25, 7.0]
    values = [-4.0, -3.0, -2.0, -0.5, -0.0, 0.0, 1.0, 2.25, 2.26, 7.0, 7.1, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    d = H.with_left_closed_code(H.with_right_closed_code(df, "x", edges, "r"), "x", edges[1:-1], "l")
    got = d.select("x", "r", "l", H.right_closed_code(F.col("x"), edges).alias("want")).collect()
    assert [r.r for r in got] == [r.want for r in got]
    assert [r.l for r in got] == [None if v is None else sum(e <= v for e in edges[1:-1]) for v in values]


def test_sink_of_several_scores(spark, tmp_path):
    from foldcraft.sources import sinks as SK
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.15, "x")], "id bigint, a double, b double, m double, other string")
    SK.write_scores(df, str(tmp_path / "oof"), {"a": "xgb", "b": "lgb", "m": "blend"})
    assert spark.read.parquet(str(tmp_path / "oof")).collect()[0].asDict() == {"id": 1, "xgb": 0.1, "lgb": 0.2, "blend": 0.15}
