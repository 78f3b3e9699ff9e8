"""Properties of folds, encodings, ranks, AUC and blends."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foldcraft.operators import encode as E
from foldcraft.operators import evaluate as N
from foldcraft.operators import folds as K
from foldcraft.operators import rank as G
from foldcraft.sources import tables as T

from .conftest import SF_SMALL


def _train(spark):
    return T.scored(spark, SF_SMALL).filter(F.col("role") == "train")


def test_fold_sizes_differ_by_at_most_one_per_class(spark):
    f = K.stratified_folds(_train(spark), k=5, seed=7).groupBy("y", "fold").count().toPandas()
    for _, g in f.groupby("y"):
        assert len(g) == 5
        assert g["count"].max() - g["count"].min() <= 1


def test_folds_partition_rows(spark):
    tr = _train(spark)
    f = K.stratified_folds(tr, k=5, seed=7)
    assert f.count() == tr.count() == f.select("id").distinct().count()


def test_folds_do_not_depend_on_partitioning(spark):
    tr = _train(spark)
    a = K.stratified_folds(tr.repartition(1), 5, 3).select("id", "fold")
    b = K.stratified_folds(tr.repartition(7), 5, 3).select("id", "fold")
    assert a.exceptAll(b).count() == 0


def test_nested_inner_folds_only_cover_outer_train(spark):
    f = K.stratified_folds(_train(spark), 5, 42)
    n = K.nested_folds(f, 5, 5, 42)
    assert n.filter(F.col("ofold") == F.col("fold")).count() == 0
    assert n.count() == 4 * f.count()


def test_oof_encoding_ignores_own_label(spark):
    """With folds held fixed, flipping a row's label leaves its nested OOF
    encoding unchanged (no leak) when the prior comes from the fit set."""
    a = T.accounts(spark, SF_SMALL)
    tr = K.stratified_folds(a.filter(F.col("role") == "train"), 5, 42)
    te = a.filter(F.col("role") == "test")
    nested = K.nested_folds(tr, 5, 5, 42, keep_own=True).cache()
    victim = tr.select("id").orderBy("id").first()["id"]
    flip = F.when(F.col("id") == victim, 1 - F.col("y")).otherwise(F.col("y"))
    cols = ["pri", "seg"]
    base = E.encode_nested(tr, te, cols, 5, 5, {"te": E.smoothed(5)}, prior_scope="fit", nested=nested)
    alt = E.encode_nested(tr.withColumn("y", flip), te, cols, 5, 5, {"te": E.smoothed(5)}, prior_scope="fit",
                          nested=nested.withColumn("y", flip))
    pick = (F.col("id") == victim) & (F.col("part") == "fit")
    x = base.filter(pick).select("ofold", "te_pri", "te_seg").orderBy("ofold").collect()
    y = alt.filter(pick).select("ofold", "te_pri", "te_seg").orderBy("ofold").collect()
    assert x == y and len(x) == 4


def test_auc_of_reversed_score(spark):
    s = _train(spark).select("s_b", "y_sig")
    a = G.auc(s, "s_b", "y_sig").first()["auc"]
    b = G.auc(s.withColumn("s_b", 1 - F.col("s_b")), "s_b", "y_sig").first()["auc"]
    assert abs((1 - a) - b) < 1e-12


def test_auc_matches_evaluator_without_binning(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = _train(spark).select(F.col("s_a").alias("rawPrediction"), F.col("y_sig").cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(numBins=0).evaluate(s)
    a = G.auc(s, "rawPrediction", "label").first()["auc"]
    assert abs(ev - a) < 1e-9


def test_pct_rank_in_unit_interval(spark):
    r = G.pct_rank(T.accounts(spark, SF_SMALL), ["tenure"]).agg(F.min("rank_tenure"), F.max("rank_tenure")).first()
    assert 0 < r[0] <= r[1] <= 1


def test_blend_weight_one_is_model_a(spark):
    t = _train(spark)
    g = N.weight_grid_auc(t, "s_a", "s_b", "y_sig", [1.0]).first()["auc"]
    a = G.auc(t, "s_a", "y_sig").first()["auc"]
    assert abs(g - a) < 1e-12


def test_pairs_by_index_equal_pairs_by_join(spark):
    """The arrays and the join beyond their bound give the same table."""
    a = T.accounts(spark, SF_SMALL).withColumn("pri", T.padded_category()).select("id", "role", "y", "pri", "seg", "svc_return", "svc_open")
    a = a.withColumn("seg", F.when((F.col("role") == "test") & (F.col("id") % 5 == 0), F.lit("new")).otherwise(F.col("seg")))
    tr = K.stratified_folds(a.filter(F.col("role") == "train"), 3, 42)
    te = a.filter(F.col("role") == "test")
    cols = ["pri", "seg", "svc_return", "svc_open"]
    one, names = E.pair_logits(tr, te, cols, 3, 2)
    two, _ = E.pair_logits(tr, te, cols, 3, 2, max_cells=0)
    assert one.columns == two.columns and len(names) == 18
    key = ["ofold", "id", "part"]
    x, y = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (one, two))
    assert len(x) == 3 * a.filter("role <> 'ref'").count() and x[key].equals(y[key])
    assert abs(x[names] - y[names]).max().max() < 1e-12
    fit = x[x.part == "fit"].groupby("ofold")[names]
    assert abs(fit.mean()).max().max() < 1e-9 and abs(fit.std(ddof=0) - 1).max().max() < 1e-9


def test_pairs_work_on_cells_not_on_rows(spark):
    """Counting makes no row per pair, and rounding follows from the cells:
    the rows meet nothing after their look-up.  Null and unseen values
    included."""
    from foldcraft.session import round6
    rows = [(i, ("a", "b", None)[i % 3], str(i % 4), i % 5 % 2) for i in range(240)]
    tr = K.stratified_folds(spark.createDataFrame(rows, "id long, c string, d string, y int"), 3, 1)
    te = spark.createDataFrame([(900 + i, ("a", "new")[i % 2], str(i)) for i in range(8)], "id long, c string, d string")
    got, names = E.pair_logits(tr, te, ["c", "d"], 3, 2, finish=round6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FLOOR" not in plan.upper().split("MAPINARROW")[0]
    want, _ = E.pair_logits(tr, te, ["c", "d"], 3, 2, max_cells=0)
    key = ["ofold", "id", "part", *names]
    x, y = (d.toPandas()[key].sort_values(key).reset_index(drop=True) for d in (got, want.select("ofold", "id", "part", *[round6(F.col(n)).alias(n) for n in names])))
    assert len(x) == 744 and x[key[:3]].equals(y[key[:3]]) and abs(x[names] - y[names]).max().max() < 2e-6
    counts = []
    real = E.cut_lineage
    E.cut_lineage = lambda df, name="stage": counts.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name)
    try:
        E.pair_logits(tr, te, ["c", "d"], 3, 2)
    finally:
        E.cut_lineage = real
    assert "Generate explode" not in dict(counts)["pair-counts"]


def test_weights_in_several_jobs_give_the_same_aucs(spark):
    d = spark.createDataFrame([(i % 7 / 7.0, i % 5 / 5.0, i % 3 % 2) for i in range(60)], "a double, b double, y int")
    weights = [i / 10 for i in range(11)]
    one, some, each = (N.weight_grid_auc(d, "a", "b", "y", weights, **k).orderBy("w").collect()
                       for k in ({}, {"at_once": 240}, {"at_once": 1}))
    assert len(one) == 11 and one == some == each


def test_computed_columns_are_not_exchanged(spark):
    """Crosses made where they are read: same encodings, base columns stored."""
    rows = [(i, ("a", "b", None)[i % 3], str(i % 4), i % 5 % 2) for i in range(120)]
    tr = K.stratified_folds(spark.createDataFrame(rows, "id long, c string, d string, y int"), 3, 1)
    te = spark.createDataFrame([(900 + i, ("a", "new")[i % 2], str(i)) for i in range(8)], "id long, c string, d string")
    cross = F.concat_ws("___", F.coalesce("c", F.lit("nan")), "d")
    stored = []
    real = E.cut_lineage
    E.cut_lineage = lambda df, name="stage": stored.append((name, df.columns)) or real(df, name)
    try:
        got = E.encode_nested(tr, te, ["x", "c"], 3, 2, {"te": E.smoothed(2)}, computed={"x": cross})
    finally:
        E.cut_lineage = real
    assert sorted(dict(stored)["nested"]) == ["c", "d", "fold", "id", "ifold", "ofold", "y"]
    want = E.encode_nested(tr.withColumn("x", cross), te.withColumn("x", cross), ["x", "c"], 3, 2, {"te": E.smoothed(2)})
    cols = ["ofold", "id", "part", "x", "c", "te_x", "te_c"]
    assert got.count() == 3 * 128 and got.select(cols).exceptAll(want.select(cols)).count() == 0


def test_one_hot_levels_are_bounded(spark):
    import pytest
    tr, te = (spark.createDataFrame([(i, str(i)) for i in range(n)], "id int, c string") for n in (5, 7))
    with pytest.raises(ValueError, match="5 levels"):
        E.one_hot(tr, te, ["c"], max_levels=4)
    assert E.one_hot(tr, te, ["c"]).columns == ["id", "c", "c_1", "c_2", "c_3", "c_4"]
    named = E.one_hot(tr, te, ["c"], levels={"c": ["6", "5"]}, max_levels=1)
    assert named.columns == ["id", "c", "c_6"] and named.filter("c_6 = 1").count() == 1


def test_golden_section_finds_the_best_weight(spark):
    """Not below a fine grid around the best, on scores with a mixed optimum."""
    t = _train(spark).select("y_sig", "s_b", ((F.col("id") * 7 % 11) / 11.0 + F.col("y_sig") * 0.4).alias("s_c"))
    w, best = N.search_weight(t, "s_b", "s_c", "y_sig", tolerance=1e-3)
    grid = N.weight_grid_auc(t, "s_b", "s_c", "y_sig", [i / 20 for i in range(21)]).agg(F.max("auc")).first()[0]
    assert 0 < w < 1 and best > grid - 1e-3
    assert abs(N.weight_grid_auc(t, "s_b", "s_c", "y_sig", [w]).first()["auc"] - best) < 1e-9


def test_strings_are_numbered_in_ranges(spark):
    from foldcraft.operators.prefix import row_number_in_order
    rows = [(g, f"{(i * 37) % 101:03d}") for g, n in (("a", 90), (None, 30), ("b", 1)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, v string")
    got = {(r.g, r.v): (r.rn, r.rn_n) for r in row_number_in_order(d, "g", ["v"]).collect()}
    for g in ("a", None, "b"):
        own = sorted(v for h, v in rows if h == g)
        assert [got[g, v] for v in own] == [(i, len(own)) for i in range(len(own))]


def test_sampled_rows_alone_are_numbered(spark):
    from foldcraft.operators.prefix import row_number_by_hash
    d = spark.range(3000).withColumn("g", F.col("id") % 3)
    every = row_number_by_hash(d, F.md5(F.col("id").cast("string")), ["g"])
    some = row_number_by_hash(d, F.md5(F.col("id").cast("string")), ["g"], wanted=lambda n: F.ceil(n * 0.1))
    assert some.exceptAll(every.filter("rn < 100")).count() == 0 and some.count() == 300


def test_pairs_travel_packed(spark):
    """Rows carry one number for their codes and come back as one array; more
    levels than a number holds take a second one."""
    rng = np.random.default_rng(8)
    cols = [f"c{i}" for i in range(16)]
    pdf = pd.DataFrame({"id": range(600), "y": rng.integers(0, 2, 600), "fold": rng.integers(0, 3, 600),
                        **{c: rng.integers(0, 17, 600).astype(str) for c in cols}})
    train = spark.createDataFrame(pdf)
    test = spark.createDataFrame(pdf.drop(columns=["y", "fold"]).assign(id=pdf.id + 1000, c3="new"))
    every, names = E.pair_logits(train, test, cols, 3, 2)
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"\b(_p\d+|_k\d+)#\d+L?[,\]]", plan)) == {"_p0", "_p1"} and "[0] AS z1_c0___c1" in plan
    got = every.toPandas().sort_values(["ofold", "id"]).reset_index(drop=True)
    assert len(names) == 360 and len(got) == 3 * 1200
    for own in (["c0", "c1"], ["c2", "c3"], ["c7", "c15"], ["c14", "c15"]):
        one, few = E.pair_logits(train, test, own, 3, 2)
        want = one.toPandas().sort_values(["ofold", "id"]).reset_index(drop=True)
        assert np.allclose(got[few], want[few], rtol=0, atol=1e-9), own


def test_nested_rows_meet_stored_offsets(spark):
    """The numbering's offsets are a stored table of known size: rows are not
    sent to every task in their place, nor shuffled to meet them."""
    d = spark.createDataFrame([(i, i % 2, i % 5) for i in range(400)], "id long, y int, fold int")
    n = K.nested_folds(d, 5, 5, 42)
    assert [f for f in n.inputFiles() if "/offsets-" in f]
    plan = n._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
