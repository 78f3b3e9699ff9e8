"""The training layer: no SQL oracle can check a fitted model, so these hold
its results against what any run must satisfy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldcraft.operators.rank import auc
from foldcraft.plans import catalog as C
from foldcraft.plans import train as TR
from foldcraft.session import release_scratch, scratch_mark

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def ids(spark):
    s = C.T.scored(spark, SF_SMALL).select("id", "role", "y_sig").toPandas()
    return {role: g for role, g in s.groupby("role")}


@pytest.fixture(scope="module")
def rounds(spark):
    """Both pseudo-label rounds of all folds, fitted once."""
    return C._pseudo_rounds(spark, SF_SMALL)


def check_scores(pdf, ids, column):
    oof, test = pdf[pdf.part == "oof"], pdf[pdf.part == "test"]
    assert sorted(oof.id) == sorted(ids["train"].id) and sorted(test.id) == sorted(ids["test"].id)
    assert pdf[column].between(0, 1).all()
    y = oof.merge(ids["train"], on="id").y_sig.to_numpy()
    r = oof[column].rank().to_numpy()
    pos = y.sum()
    return (r[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_plain_models(spark, ids):
    a = C.q_gbt_oof(spark, SF_SMALL).toPandas()
    b = C.q_logreg_oof(spark, SF_SMALL).toPandas()
    assert check_scores(a, ids, "score") > 0.6 and check_scores(b, ids, "score") > 0.6


def test_models_on_encodings(spark, ids):
    mark = scratch_mark()
    got = C.q_te_models_oof(spark, SF_SMALL).toPandas()
    release_scratch(spark, mark)
    assert scratch_mark() == mark
    for column in ("gbt", "logreg", "blend"):
        assert check_scores(got, ids, column) > 0.58, column
    assert np.allclose(got.blend, (got.gbt + got.logreg) / 2)


def test_same_seed_same_scores(spark):
    tr, te = C._model_frame(spark, SF_SMALL)
    one, two = (TR.assemble_oof(TR.oof_scores(tr, te, C.MODEL_FEATURES, "y", lambda: TR.gbt("y", 3, 3), [0, 1, 2])[0]).toPandas()
                .sort_values(["part", "id"]).score.to_numpy() for _ in range(2))
    assert np.array_equal(one, two)


def test_every_fold_is_validated(spark, rounds, monkeypatch):
    got = C.q_gbt_variants(spark, SF_SMALL).toPandas()
    assert len(got) == 4 * C.MODEL_FOLDS and set(got.fold) == set(range(C.MODEL_FOLDS))
    monkeypatch.setattr(C, "_pseudo_rounds", lambda *_: rounds)
    kept = C.q_pseudo_gbt(spark, SF_SMALL).toPandas()
    assert sorted(kept.fold) == list(range(C.MODEL_FOLDS))
    assert all(r.auc_kept == (r.auc_round2 if r.keep_pseudo else r.auc_round1) for r in kept.itertuples())


def test_logistic_optimum(spark):
    """At the optimum the weighted residuals sum to zero."""
    tr, _ = C._model_frame(spark, SF_SMALL)
    model = TR._fit(tr, TR._stages(C.MODEL_FEATURES, True), lambda n: TR.logreg("y", "w", 200, 1.0, n), "y", "w")
    n = {r.y: r["count"] for r in tr.groupBy("y").count().collect()}
    w = F.when(F.col("y") == 1, 1 / n[1]).otherwise(1 / n[0])
    p = vector_to_array(F.col("probability"))[1]
    assert abs(model.transform(tr).agg(F.sum(w * (p - F.col("y")))).first()[0]) < 1e-3


def test_importances_sum_to_one(spark):
    got = C.q_feature_importance(spark, SF_SMALL).toPandas()
    assert abs(got.importance.sum() - 1) < 1e-9 and len(got) == len(C.MODEL_FEATURES)


def test_fold_report(spark):
    rep = C.q_gbt_fold_report(spark, SF_SMALL).toPandas()
    assert sorted(rep.fold) == list(range(C.MODEL_FOLDS)) and (rep.model_size > 0).all() and (rep.auc > 0.55).all()
    assert auc(spark.createDataFrame([(0.2, 0), (0.8, 1)], "s double, y int"), "s", "y").first().auc == 1.0


# best iteration, categories, sweeps with fits ------------------------------------

def test_margins_of_all_iterations(spark):
    """The last margin is the model's; each earlier one is the truncated model's."""
    tr, te = C._model_frame(spark, SF_SMALL)
    asm = TR.VectorAssembler(inputCols=C.MODEL_FEATURES, outputCol="features", handleInvalid="keep")
    x = asm.transform(tr)
    model = TR.gbt("y", 6, 4, 0.3).fit(x)
    staged = TR.staged_margins(model, x.select("id", "features"))
    assert staged.columns == ["id", "features", "margins"]
    for n in (1, 3, 6):
        cut = TR.truncated(model, n)
        assert cut.getNumTrees == n
        j = TR._prob(cut.transform(x)).select("id", "score").join(staged.select("id", TR.margin_score(F.col("margins")[n - 1]).alias("s")), "id")
        assert j.filter(F.abs(F.col("score") - F.col("s")) > 1e-12).count() == 0
    assert staged.filter(F.size("margins") != 6).count() == 0


def test_best_iterations_by_hand(spark):
    rows = [("a", i, v) for i, v in enumerate([.5, .7, .7, .6, .65, .9], 1)] + [("b", i, v) for i, v in enumerate([.9, .8], 1)]
    d = spark.createDataFrame(rows, "k string, iteration int, auc double")

    def best(patience):
        return {r.k: tuple(r)[1:] for r in TR.best_iterations(d, ["k"], patience).collect()}

    assert best(None) == {"a": (6, .9, 6, .9), "b": (1, .9, 2, .8)}
    assert best(3) == {"a": (2, .7, 5, .65), "b": (1, .9, 2, .8)}
    assert best(1) == {"a": (2, .7, 3, .7), "b": (1, .9, 2, .8)}


def test_stopping_on_encoded_folds(spark, ids):
    got = C.q_gbt_stopped_oof(spark, SF_SMALL).toPandas()
    assert check_scores(got, ids, "score") > 0.58
    rep = C.q_gbt_best_iteration(spark, SF_SMALL).toPandas()
    assert len(rep) == 2 * C.MODEL_FOLDS and (rep.best_auc >= rep.last_auc).all()
    assert ((1 <= rep.best_iteration) & (rep.best_iteration <= rep.stopped_at)).all()
    assert (rep.stopped_at - rep.best_iteration <= C.PATIENCE).all()


def test_categories_are_no_numbers(spark, ids, monkeypatch):
    scores, report = models = C._rebalanced_models(spark, SF_SMALL)
    monkeypatch.setattr(C, "_rebalanced_models", lambda *_: models)
    rep = report.toPandas()
    assert sorted(rep.set_id) == [1, 2, 3, 4, 5] and (rep.best_auc > 0.6).all()
    pdf = scores.toPandas()
    test, valid = pdf[pdf.part == "test"], pdf[pdf.part == "valid"]
    assert all(sorted(g.id) == sorted(ids["test"].id) for _, g in test.groupby("set_id")) and pdf.score.between(0, 1).all()
    for s, g in valid.groupby("set_id"):  # scores are those of the best iteration
        r, pos = g.score.rank().to_numpy(), g.y.sum()
        a = (r[g.y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(g) - pos))
        assert abs(a - rep.set_index("set_id").best_auc[s]) < 1e-9
    mean = C.q_rebalanced_gbt(spark, SF_SMALL).toPandas()
    assert sorted(mean.id) == sorted(ids["test"].id)
    a = C.T.scored(spark, SF_SMALL).filter("role = 'train'")
    ready = TR.Pipeline(stages=TR.categorical_stages(C.CAT_FEATURES, C.CAT_NUMBERS)).fit(a).transform(a)
    attrs = ready.schema["features"].metadata["ml_attr"]["attrs"]
    assert len(attrs["nominal"]) == len(C.CAT_FEATURES) and len(attrs["numeric"]) == len(C.CAT_NUMBERS)


def test_kept_rounds_scores(spark, ids, rounds, monkeypatch):
    monkeypatch.setattr(C, "_pseudo_rounds", lambda *_: rounds)
    got = C.q_pseudo_gbt_scores(spark, SF_SMALL).toPandas()
    assert check_scores(got, ids, "score") > 0.6
    scores, by = rounds
    kept = {r.fold: 2 if r.keep_pseudo else 1 for r in by.collect()}
    every = scores.filter("part = 'oof'").toPandas()
    want = every[every["round"] == every.fold.map(kept)].set_index("id").score
    assert np.allclose(got[got.part == "oof"].set_index("id").score.sort_index(), want.sort_index())


def test_sweeps_with_fits(spark):
    rep = C.q_threshold_refits(spark, SF_SMALL).toPandas().sort_values("threshold")
    assert list(rep.threshold) == C.REFIT_THRESHOLDS and (np.diff(rep.n_pseudo) <= 0).all() and rep.n_pseudo.max() > 0
    assert rep.oof_auc.isna().equals(rep.n_pseudo == 0) and (rep.base_auc > 0.6).all()
    assert np.allclose((rep.oof_auc - rep.base_auc).dropna(), rep.improvement.dropna())
    fits = C.q_param_sweep_fits(spark, SF_SMALL).toPandas()
    assert len(fits.drop_duplicates(["m", "keep_original", "feature_set"])) == 20 == len(fits)
    assert fits.oof_auc.between(0.5, 1).all()
    assert fits[fits.keep_original == 1].oof_auc.mean() > fits[fits.keep_original == 0].oof_auc.mean()


# one read of the tables, one making of the vectors ------------------------------

def test_model_rows_are_stored(spark):
    """Folds, train and test rows come from stored rows, not from the tables."""
    mark = scratch_mark()
    for d in [*C._model_frame(spark, SF_SMALL), C._encoded_frame(spark, SF_SMALL)]:
        assert d.inputFiles() and not [f for f in d.inputFiles() if "/testdata/" in f]
    release_scratch(spark, mark)


def test_columns_joined_before_folds(spark):
    """Columns by id given to the encoder are those of a join behind it, repeated ids too."""
    train = spark.createDataFrame([(i % 25, i % 2, i % 3, "ab"[i % 2 * (i % 5 > 1)], float(i)) for i in range(1, 31)],
                                  "id long, y int, fold int, c string, x double")
    test = spark.createDataFrame([(i, "abz"[i % 3], float(i)) for i in range(100, 107)], "id long, c string, x double")
    more = train.select("id", "y", "x").unionByName(test.select("id", F.lit(None).cast("int").alias("y"), "x"))
    got = C.E.encode_per_fold(train, test, ["c"], 3, {"te": C.E.smoothed(2)}, joined=more)
    want = C.E.encode_per_fold(train, test, ["c"], 3, {"te": C.E.smoothed(2)}).drop("y").join(more, "id").select(*got.columns)
    rows = [sorted(map(str, d.select("id", "fold", "part", "y", "x", F.round("te_c", 9).alias("te_c")).collect())) for d in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == 3 * (20 + 5 * 4 + 7)


def test_fits_keep_their_vectors(spark):
    """An estimator that reads its input again reads kept vectors; they are
    freed behind it, and the model is the one of the plain fit."""
    tr, _ = C._model_frame(spark, SF_SMALL)
    x = C.cut_lineage(TR._stages(C.MODEL_FEATURES, False)[0].transform(tr))
    seen = []

    class Estimator:
        def fit(self, rows):
            seen.append((rows, rows.storageLevel.useMemory, rows.columns))
            return TR.gbt("y", 3, 3).fit(rows)

    model = TR.fit_ready(Estimator(), x, ["y", "features"])
    assert seen[0][1:] == (True, ["y", "features"]) and not seen[0][0].storageLevel.useMemory
    assert model.toDebugString.split("\n", 1)[1] == TR.gbt("y", 3, 3).fit(x).toDebugString.split("\n", 1)[1]


def test_margins_are_compiled(spark):
    """No function on arrays runs per row to sum the trees' values."""
    tr, _ = C._model_frame(spark, SF_SMALL)
    x = TR._stages(C.MODEL_FEATURES, False)[0].transform(tr)
    model = TR.gbt("y", 3, 3).fit(x)
    plan = TR.staged_margins(model, x)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "transform(" not in plan and "aggregate(" not in plan
