"""Kernels lose no row: null segments and labels, NaN, ids above 2^53."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldcraft.operators import encode as E
from foldcraft.operators import folds as K
from foldcraft.operators import rank as G
from foldcraft.operators import stats as ST
from foldcraft.operators.prefix import row_number_by_hash, row_number_by_value, running_counts


def test_null_segments_are_segments(spark):
    d = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 3).alias("seg"),
                                (F.col("id") % 7).cast("double").alias("x"))
    for out in (row_number_by_hash(d, K.seeded_key(1), ["seg"], tiebreak="id"),
                row_number_by_value(d, "x", ["seg"], tiebreak="id")):
        rows = out.collect()
        assert len(rows) == 100
        for seg in (None, 0, 1, 2):
            own = sorted(r.rn for r in rows if r.seg == seg)
            assert own == list(range(len(own))) and {r.rn_n for r in rows if r.seg == seg} == {len(own)}
    hist = d.groupBy("seg", "x").agg(F.count(F.lit(1)).alias("c"))
    got = running_counts(hist, "x", ["c"], ["seg"]).collect()
    assert len(got) == hist.count()
    assert sum(r.c for r in got if r.seg is None) == 10 == {r.c_total for r in got if r.seg is None}.pop()


def test_auc_of_a_null_segment(spark):
    d = spark.createDataFrame([(None, 0.1, 0), (None, 0.9, 1), ("a", 0.9, 0), ("a", 0.1, 1)], "seg string, s double, y int")
    assert {r.seg: r.auc for r in G.auc(d, "s", "y", ["seg"]).collect()} == {None: 1.0, "a": 0.0}


def test_rows_without_label_are_an_error(spark):
    d = spark.range(40).select("id", F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("int")).alias("y"))
    for make in (lambda: K.stratified_folds(d), lambda: K.stratified_holdout(d), lambda: K.multi_seed_folds(d),
                 lambda: K.rebalanced_sets(d, 2, 3)):
        with pytest.raises(PySparkException, match="rows have no y"):
            make().collect()
    assert K.stratified_folds(d.filter("y is not null")).count() == 32


def test_frequency_leaves_nulls_out(spark):
    d = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "v double")
    got = sorted(round(r.freq_v, 6) for r in ST.frequency_encoding(d, ["v"]).collect())
    assert got == [0.0, 0.0, 0.333333, 0.666667, 0.666667]


def test_nan_has_no_rank(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, float("nan")), (4, None), (5, -0.0), (6, 0.0)], "id int, v double")
    got = {r.id: r.rank_v for r in G.pct_rank(d, ["v"]).collect()}
    assert got == {1: 0.75, 2: 1.0, 3: None, 4: None, 5: 0.375, 6: 0.375}


def test_first_seen_codes_of_large_ids(spark):
    base = 2 ** 53
    d = spark.createDataFrame([(base + 1, "b"), (base, "a"), (base + 2, "c"), (base + 3, "a")], "id long, k string")
    assert {r.k: r.fcode_k for r in G.first_seen_codes(d, d, ["k"]).collect()} == {"a": 0, "b": 1, "c": 2}


def test_null_category_leaves_its_own_fold_out(spark):
    st = spark.createDataFrame([("c", None, 0, 3.0, 1.0), ("c", None, 1, 5.0, 2.0), ("c", "x", 0, 2.0, 2.0)],
                               "col string, value string, fold int, n double, s double")
    got = {(r.value, r.fold): (r.n, r.s) for r in E.exclude_each(st, ["col", "value"], "fold", range(2)).collect()}
    assert got == {(None, 0): (5.0, 2.0), (None, 1): (3.0, 1.0), ("x", 0): (0.0, 0.0), ("x", 1): (2.0, 2.0)}
