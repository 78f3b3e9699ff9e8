"""Out-of-fold training and scoring with MLlib.

The boosters of the reference are third-party single-machine libraries;
here the models are MLlib estimators (``GBTClassifier``,
``LogisticRegression``), which build trees from distributed histograms.
The driver loop is only over folds (k fits); every fit, every scoring and
every AUC is a distributed job, and OOF assembly is a union of the
per-fold scored validation rows keyed by id (L8), test scores averaged by
one grouped aggregate (L9).

Best iteration.  A boosted model's margin after i trees is the sum of its first
i trees' leaf values, so one pass that notes every row's leaf per tree gives the
margins of all iterations (``staged_margins``).  Exploded by iteration they are
one grouped exact AUC; the best iteration follows from that table of folds x
iterations rows, and the truncated model's scores are already there: choosing
costs no second fit and no second scoring.
"""

from __future__ import annotations

import re
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Callable, Sequence

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import auc
from ..session import cut_lineage


def gbt(label: str = "y", max_iter: int = 10, max_depth: int = 4, step: float = 0.1,
        subsample: float = 0.8, seed: int = 42, validation_col: str | None = None,
        weight_col: str | None = None, min_instances: int = 1, min_info_gain: float = 0.0) -> GBTClassifier:
    """Boosted trees; ``validation_col`` turns on early
    stopping on the flagged rows (MLlib stops on its loss, not on AUC)."""
    extra = {"validationIndicatorCol": validation_col, "validationTol": 0.0} if validation_col else {}
    g = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                      stepSize=step, subsamplingRate=subsample, seed=seed,
                      minInstancesPerNode=min_instances, minInfoGain=min_info_gain, **extra)
    if weight_col:
        g = g.setWeightCol(weight_col)
    return g


def _prob(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col("probability"))[1])


def _stages(features: Sequence[str], scale: bool) -> list:
    """Feature vector; D13 / L5: standardised with the fit rows' statistics."""
    asm = VectorAssembler(inputCols=list(features), outputCol="raw" if scale else "features",
                          handleInvalid="keep")
    return [asm] + ([StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)] if scale else [])


#: fits that run at a time: one's short passes fill the cores that the other
#: leaves idle, and two fits' rows are in memory
FITS_AT_ONCE = 2


def fit_ready(estimator, ready: DataFrame, columns: Sequence[str]):
    """Fits on ``columns`` of rows that have their features' vector.  Before its
    own compact copy an estimator reads its input three times (size, splits or
    moments, copy): the vectors are made once and kept until it is fitted."""
    x = ready.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(x)
    finally:
        x.unpersist()


def _fit(fit_rows: DataFrame, stages: list, make_estimator, label: str, balanced: str | None):
    """Fits one model.  ``make_estimator`` gets the number of fit rows if a
    weight column ``balanced`` is asked for: n / (2 n_class) of these rows."""
    if not balanced:
        estimator = make_estimator()
    else:
        n = {r[label]: r["count"] for r in fit_rows.groupBy(label).count().collect()}  # two classes
        total = sum(n.values())
        w = F.when(F.col(label) == 1, total / (2.0 * n.get(1, total))).otherwise(total / (2.0 * n.get(0, total)))
        estimator, fit_rows = make_estimator(total), fit_rows.withColumn(balanced, w)
    assembler, rest = stages[0], stages[1:]
    extra = [c for c in ("validationIndicatorCol",) if estimator.hasParam(c) and estimator.isSet(c)]
    columns = [label, assembler.getOutputCol(), *[estimator.getOrDefault(c) for c in extra], *([balanced] if balanced else [])]
    model = fit_ready(Pipeline(stages=[*rest, estimator]), assembler.transform(fit_rows), columns)
    return PipelineModel(stages=[assembler, *model.stages])


def encoded_scores(rows: DataFrame, features: Sequence[str], label: str, make_estimator, folds: Sequence[int],
                   scale: bool = False, balanced: str | None = None) -> DataFrame:
    """Per fold, fits on the rows of part 'fit' and scores those of 'valid'
    and 'test'.  ``rows`` come encoded per fold (operators.encode): a row is
    there once per fold, with that fold's encodings.  Returns (id, part, fold,
    score, label)."""
    def one(f):
        own = rows.filter(F.col("fold") == f)
        model = _fit(own.filter(F.col("part") == "fit"), _stages(features, scale), make_estimator, label, balanced)
        return _prob(model.transform(own.filter(F.col("part") != "fit"))).select(
            "id", F.when(F.col("part") == "valid", "oof").otherwise("test").alias("part"), "fold", "score", label)

    return cut_lineage(reduce(DataFrame.unionByName, in_parallel([lambda f=f: one(f) for f in folds], FITS_AT_ONCE)), "scores")


def oof_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
               make_estimator, folds: Sequence[int], early_stop: bool = False,
               scale: bool = False, balanced: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit one model per fold on the other folds, score the fold's rows and
    the test rows.  Returns (scored rows: id, part, fold, score; per-fold
    report: fold, n_trees / iterations, val_auc)."""
    stages = _stages(features, scale)
    keep = ["id", label, "fold", *features]
    train = cut_lineage(train.select(*keep))
    test = cut_lineage(test.select("id", *features))

    def one(f):
        if early_stop:
            fit_rows = train.withColumn("_is_val", F.col("fold") == f)
        else:
            fit_rows = train.filter(F.col("fold") != f)
        model = _fit(fit_rows, stages, make_estimator, label, balanced)
        val = _prob(model.transform(train.filter(F.col("fold") == f))).select(
            "id", F.lit("oof").alias("part"), F.lit(f).alias("fold"), "score", label)
        tst = _prob(model.transform(test)).select(
            "id", F.lit("test").alias("part"), F.lit(f).alias("fold"), "score", F.lit(None).cast("int").alias(label))
        last = model.stages[-1]
        size = getattr(last, "getNumTrees", None)
        return val.unionByName(tst), (int(f), int(size) if size is not None else int(last.summary.totalIterations))

    parts, report = zip(*in_parallel([lambda f=f: one(f) for f in folds], FITS_AT_ONCE))
    scored = reduce(DataFrame.unionByName, parts)
    scored = cut_lineage(scored)
    aucs = auc(scored.filter(F.col("part") == "oof"), "score", label, ["fold"])
    rep = train.sparkSession.createDataFrame(list(report), ["fold", "model_size"]).join(aucs, "fold")
    return scored, rep


def assemble_oof(scored: DataFrame) -> DataFrame:
    """Each train row's OOF score; test scores averaged over folds."""
    oof = scored.filter(F.col("part") == "oof").select("id", "part", "score")
    tst = scored.filter(F.col("part") == "test").groupBy("id").agg(F.avg("score").alias("score")).select(
        "id", F.lit("test").alias("part"), "score")
    return oof.unionByName(tst)


def logreg(label: str = "y", weight_col: str | None = None, max_iter: int = 100, c: float = 1.0,
           n_fit: int = 1) -> LogisticRegression:
    """Logistic regression with inverse strength ``c`` over ``n_fit``
    rows: the loss is a mean here, so regParam = 1 / (c * n_fit)."""
    lr = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, regParam=1.0 / (c * n_fit))
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr


def importances(train: DataFrame, features: Sequence[str], label: str, est: GBTClassifier) -> DataFrame:
    """Gain importances of a tree model as a (feature, importance)
    table (the model's small vector is the only thing on the driver)."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    model = est.fit(asm.transform(train))
    imp = model.featureImportances.toArray().tolist()
    return train.sparkSession.createDataFrame(list(zip(features, [float(v) for v in imp])),
                                              ["feature", "importance"])


# ------------------------------------------------------------ best iteration

def leaf_values(model: GBTClassificationModel) -> list[list[float]]:
    """Per tree, its weight times the predictions of its leaves, left to right
    (the order of leaf indices); of the size of the model."""
    trees = re.split(r"Tree \d+ \(weight ([-+\d.Ee]+)\):", model.toDebugString)[1:]
    return [[float(w) * float(v) for v in re.findall(r"Predict: (\S+)", text)] for w, text in zip(trees[::2], trees[1::2])]


def staged_margins(model: GBTClassificationModel, rows: DataFrame, out: str = "margins") -> DataFrame:
    """``rows`` (with the features' vector) and the array of the margins after
    1, 2, ... trees."""
    m = model.copy()
    for unused in ("prediction", "probability", "rawPrediction"):
        m.set(m.getParam(f"{unused}Col"), "")
    sums: list[Column] = []  # plain sums of looked-up values: Spark compiles these, not functions on arrays
    for i, tree in enumerate(leaf_values(model)):
        value = F.get(F.expr(f"array({', '.join(f'{v!r}D' for v in tree)})"), F.get("_leaves", F.lit(i)).cast("int"))
        sums.append(sums[-1] + value if sums else value)
    leaves = m.setLeafCol("_leaf").transform(rows).withColumn("_leaves", vector_to_array(F.col("_leaf")))
    return leaves.withColumn(out, F.array(*sums)).drop("_leaf", "_leaves")


def margin_score(margin: Column) -> Column:
    """MLlib's probability of class 1 from a boosted margin."""
    return 1 / (1 + F.exp(-2 * margin))


def truncated(model: GBTClassificationModel, n_trees: int) -> GBTClassificationModel:
    """The model of the first ``n_trees`` trees."""
    gateway, old = SparkContext._active_spark_context._gateway, model._java_obj.trees()
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n_trees)
    weights = gateway.new_array(gateway.jvm.double, n_trees)
    for i in range(n_trees):
        trees[i], weights[i] = old[i], float(model.treeWeights[i])
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{n_trees}", trees, weights)
    return GBTClassificationModel(cut).setFeaturesCol(model.getFeaturesCol())


def staged_auc(staged: DataFrame, label: str, segments: Sequence[str], margins: str = "margins") -> DataFrame:
    """(segments, iteration, auc): exact AUC of every iteration, in one job."""
    long = staged.select(*segments, label, F.posexplode(margins).alias("i", "margin"))
    return auc(long.withColumn("iteration", F.col("i") + 1), "margin", label, [*segments, "iteration"]).select(
        *segments, "iteration", "auc")


def best_iterations(aucs: DataFrame, segments: Sequence[str], patience: int | None = None) -> DataFrame:
    """(segments, best_iteration, best_auc, stopped_at, last_auc) of a
    table (segments, iteration, auc): training stops after ``patience``
    iterations without a new best AUC, the earliest best one counts.  One row
    per fold and iteration, so windows over a segment are small."""
    segs = list(segments)
    so_far = Window.partitionBy(*segs).orderBy("iteration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*segs)
    best = F.max(F.struct("auc", (-F.col("iteration")).alias("minus"))).over(so_far)
    d = aucs.select(*segs, "iteration", "auc", best.alias("b")).select(
        *segs, "iteration", "auc", F.col("b.auc").alias("top"), (-F.col("b.minus")).alias("at"))
    wait = F.col("iteration") - F.col("at") >= (patience if patience is not None else 1 << 30)
    d = d.withColumn("stop", F.coalesce(F.min(F.when(wait, F.col("iteration"))).over(every), F.max("iteration").over(every)))
    last = F.max(F.when(F.col("iteration") == F.col("stop"), F.struct("at", "top", "auc")))
    d = d.groupBy(*segs).agg(last.alias("x"), F.max("stop").alias("stopped_at"))
    return d.select(*segs, F.col("x.at").alias("best_iteration"), F.col("x.top").alias("best_auc"), "stopped_at",
                    F.col("x.auc").alias("last_auc"))


def stopped_scores(parts: dict[int, tuple[DataFrame, DataFrame]], stages: list, make_estimator, label: str,
                   patience: int | None, segment: str = "fold", parallelism: int = FITS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """Boosting with stopping on AUC.  ``parts``: segment -> (rows to fit,
    rows to score (id, part, label, features...), of which part 'valid'
    decides).  Returns (scores of the models truncated at their best
    iteration: id, part, segment, score, label; report per segment)."""
    def run(k: int) -> DataFrame:
        fit_rows, score_rows = parts[k]
        features = Pipeline(stages=stages).fit(fit_rows)
        model = fit_ready(make_estimator(), features.transform(fit_rows), [label, "features"])
        staged = staged_margins(model, features.transform(score_rows))
        return cut_lineage(staged.select("id", "part", F.lit(k).alias(segment), label, "margins"), "margins")

    staged = None
    for d in in_parallel([lambda k=k: run(k) for k in parts], parallelism):
        staged = d if staged is None else staged.unionByName(d)
    aucs = staged_auc(staged.filter(F.col("part") == "valid"), label, [segment])
    report = cut_lineage(best_iterations(aucs, [segment], patience), "best-iterations")
    best = report.select(F.col(segment).alias("_s"), "best_iteration")  # one row per segment
    scores = staged.join(F.broadcast(best), F.col(segment) == F.col("_s")).select(
        "id", "part", segment, margin_score(F.get("margins", F.col("best_iteration") - 1)).alias("score"), label)
    return scores, report


def in_parallel(jobs: Sequence[Callable], parallelism: int) -> list:
    """Results of jobs that run ``parallelism`` at a time: while one fit
    waits for its last tasks, another's fill the cluster."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), list(jobs), chunksize=1)


# ------------------------------------------------------- categories in trees

def categorical_stages(categories: Sequence[str], numbers: Sequence[str]) -> list:
    """Categories enter as nominal attributes (codes that trees split as
    sets, not as numbers); a category that the fit rows don't have is one of
    its own.  A column needs fewer levels than the estimator's maxBins."""
    codes = [f"_code_{c}" for c in categories]
    return [StringIndexer(inputCols=list(categories), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=[*codes, *numbers], outputCol="features", handleInvalid="keep")]


# ------------------------------------------------------------- many models

def scored_by(models: dict[tuple, Callable[[], DataFrame]], names: Sequence[str], path: str, spark, parallelism: int) -> DataFrame:
    """Runs every model's job (fit, then rows (id, score, label...)) and
    stores its scores under its own key; returns all rows with the keys as
    columns.  The jobs run ``parallelism`` at a time."""
    def run(key):
        folder = "/".join(f"{n}={v}" for n, v in zip(names, key))
        models[key]().write.mode("overwrite").parquet(f"{path}/{folder}")

    in_parallel([lambda key=key: run(key) for key in models], parallelism)
    return spark.read.option("basePath", path).parquet(path)
