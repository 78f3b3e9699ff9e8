"""Boosted trees for many configurations over the same rows, grown on counted cells.

A tree sees nothing of a row but its label and the bins of its features, and
configurations that differ in smoothing or columns read the same rows: rows
with the same categories, bins and label are one cell that is counted once for
all of them.  Fitting a configuration reads cells, not rows.  The models are
those that ``GBTClassifier`` fits on the rows:

* the bins are its own: between neighbouring values, or of equal frequency where
  a feature has more values than bins (from all rows; the estimator takes the
  equal frequencies from 10,000 sampled rows if there are more);
* every tree's subsample is drawn per row before rows are counted, by the
  generator and the seeds that the estimator uses, so it is the same draw for
  rows read in the same partitions;
* splits, leaves and residuals follow the estimator's rules for variance and
  logistic loss.

A level of all trees is one job: tasks add their cells up in histograms (model,
node, feature, bin), whose sums, of the models' size, decide the splits.  Cells
are at most as many as rows; nothing row-sized reaches the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running_counts
from ..session import cut_lineage

#: a node whose impurity is below this is a leaf (MLUtils.EPSILON)
PURE = 2.0 ** -52


# ------------------------------------------------------------------- bins

def split_points(hist: DataFrame, max_bins: int) -> dict[tuple, np.ndarray]:
    """(fold, feature) -> a tree's thresholds, for distinct (fold, feature,
    value, c): midpoints of neighbouring values, all of them if these fit, else
    where the running count passes the next multiple of n / max_bins.

    A value's rank among the multiples (``k``) follows from running counts; a
    threshold can only lie at one of the first ``max_bins`` values of a rank, so
    the driver gets at most max_bins * (max_bins + 1) values a feature."""
    segs = ["fold", "feature"]
    rc = running_counts(hist, "value", ["c"], segs)
    middle = F.col("c_before") + F.col("c") / 2
    k = F.ceil(middle * max_bins / F.col("c_total")) - 1  # multiples below the middle of its counts
    rc = cut_lineage(rc.select(*segs, "value", k.cast("int").alias("k")), "ranks")
    by = Window.partitionBy(*segs, "k").orderBy("value")
    first = rc.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= max_bins + 1).drop("i")
    last = rc.groupBy(*segs, "k").agg(F.max("value").alias("last"), F.count(F.lit(1)).alias("n"))
    found = first.join(last, [*segs, "k"]).toPandas().sort_values([*segs, "k", "value"])
    out = {}
    for key, seg in found.groupby(segs):
        points, previous = [], None
        if seg.drop_duplicates("k").n.sum() <= max_bins:  # every value has a bin of its own
            v = seg.value.to_numpy()
            points = list((v[:-1] + v[1:]) / 2)
        else:
            for rank, part in seg.groupby("k"):
                for v in part.value:
                    if previous is not None and len(points) < min(rank, max_bins - 1):
                        points.append((previous + v) / 2)
                    previous = v
                previous = part["last"].iloc[0]
        out[key] = np.array(points, float)
    return out


def number(c: str) -> Column:
    """A feature's value; the estimator takes finite numbers only."""
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(F.raise_error(F.lit(f"{c} has values that are NaN or infinite, or none")))


def bin_of(value: Column, points: np.ndarray) -> Column:
    """How many thresholds are below the value."""
    return reduce(lambda a, b: a + b, [(value > F.lit(float(p))).cast("int") for p in points], F.lit(0)).cast("short")


# ------------------------------------------------------------------ cells

def levels_of(rows: DataFrame, cols: Sequence[str], encodings: Sequence[str], encoded: str) -> DataFrame:
    """(fold, col, value, an encoding each, n): what each category is encoded
    as per fold, and how many rows to fit have it.  ``encoded`` gives a
    column's name from {col} and {stat}."""
    parts = []
    for c in cols:
        g = rows.groupBy("fold", F.col(c).cast("string").alias("value")).agg(
            *[F.max(encoded.format(col=c, stat=e)).alias(e) for e in encodings],
            F.sum((F.col("part") == "fit").cast("long")).alias("n"))
        parts.append(g.select(F.col("fold").cast("int").alias("fold"), F.lit(c).alias("col"), "value", *encodings, "n"))
    return cut_lineage(reduce(DataFrame.unionByName, parts), "levels")


def _binned_levels(levels: DataFrame, encodings: Sequence[str], points: dict[tuple, np.ndarray]) -> DataFrame:
    """(fold, col, value, the bin of each encoding)."""
    def code(batches):
        for b in batches:
            keys = list(zip(b.column("fold").to_pylist(), b.column("col").to_pylist()))
            bins = [pa.array([np.searchsorted(points.get((f, f"{e} {c}"), ()), v) for (f, c), v in zip(keys, b.column(e).to_pylist())], pa.int16()) for e in encodings]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("fold", "col", "value")), *bins],
                                             names=["fold", "col", "value", *encodings])

    schema = "fold int, col string, value string, " + ", ".join(f"{e} short" for e in encodings)
    return cut_lineage(levels.select("fold", "col", "value", *encodings).mapInArrow(code, schema), "levels")


def count_cells(rows: DataFrame, sets: dict[str, Sequence[str]], encodings: Sequence[str], plain: Sequence[str], label: str,
                folds: Sequence[int], estimator: GBTClassifier, encoded: str = "te_{stat}_{col}") -> tuple[DataFrame, dict[tuple, np.ndarray]]:
    """Cells (name, keep, fold, part, label, n, bag_0.., bins...) of rows
    encoded per fold (operators.encode): for every set of categories, without
    (keep = 0) and with (1) the ``plain`` columns, those rows that no model can
    tell apart.  n counts the rows, bag_t those of tree t's subsample.  Also the
    thresholds per (fold, feature); features are "<encoding> <column>" and the
    plain columns."""
    cols = list(dict.fromkeys(c for s in sets.values() for c in s))
    levels = levels_of(rows, cols, encodings, encoded)
    of_levels = levels.filter("n > 0").select("fold", "n", F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"{e} "), "col").alias("feature"), F.col(e).alias("value")) for e in encodings])).alias("x")).groupBy("fold", "x.feature", "x.value").agg(F.sum("n").alias("c"))
    of_plain = [rows.filter("part = 'fit'").groupBy("fold", number(p).alias("value")).agg(
        F.count(F.lit(1)).alias("c")).select("fold", F.lit(p).alias("feature"), "value", "c") for p in plain]
    points = split_points(reduce(DataFrame.unionByName, of_plain, of_levels), estimator.getMaxBins())

    n_trees, rate, seed = estimator.getMaxIter(), estimator.getSubsamplingRate(), estimator.getSeed()
    bags = [f"bag_{t}" for t in range(n_trees)]
    parts = []
    for f in folds:
        bins = [bin_of(number(p), points.get((f, p), ())).alias(p) for p in plain]
        for part in ("fit", "valid"):
            own = rows.filter((F.col("fold") == f) & (F.col("part") == part))
            drawn = [(F.lit(part == "fit") if rate == 1 or part != "fit" else F.rand(seed + 1 + t) < rate).cast("long").alias(b)
                     for t, b in enumerate(bags)]
            own = own.select(label, *[F.col(c).cast("string").alias(c) for c in cols], *bins, *drawn)
            parts.append(own.groupBy(label, *cols, *plain).agg(F.count(F.lit(1)).alias("n"), *[F.sum(b).alias(b) for b in bags]).select(
                F.lit(f).alias("fold"), F.lit(part).alias("part"), "*"))
    cells = cut_lineage(reduce(DataFrame.unionByName, parts), "cells")

    coded, views = _binned_levels(levels, encodings, points), []
    for name, chosen in sets.items():
        for keep in (0, 1):
            v = cells.groupBy("fold", "part", label, *chosen, *list(plain) * keep).agg(*[F.sum(c).alias(c) for c in ("n", *bags)])
            for c in chosen:
                own = coded.filter(F.col("col") == c).select(F.col("fold").alias("_f"), F.col("value").alias("_v"), *[
                    F.col(e).alias(f"{e} {c}") for e in encodings])
                v = v.join(own, (F.col("fold") == F.col("_f")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_f", "_v", c)
            views.append(v.select(F.lit(name).alias("name"), F.lit(keep).alias("keep"), "*"))
    return cut_lineage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), views), "model-cells"), points


# ----------------------------------------------------------------- models

class Trees:
    """A model's trees, nodes in heap order from 1."""

    def __init__(self, features: Sequence[str], points: Sequence[np.ndarray], max_depth: int, step: float):
        self.features, self.points, self.depth, self.step = list(features), list(points), max_depth, step
        self.feature: list[np.ndarray] = []  # of a node's split, -1 in a leaf
        self.bin: list[np.ndarray] = []  # the last one that goes left
        self.value: list[np.ndarray] = []
        self.impurity: list[np.ndarray] = []

    def start(self) -> None:
        size = 2 << self.depth
        self.feature.append(np.full(size, -1))
        for nodes in (self.bin, self.value, self.impurity):
            nodes.append(np.zeros(size, np.int64 if nodes is self.bin else float))

    def nodes(self, x: np.ndarray, t: int) -> np.ndarray:
        """The node of tree ``t`` that each cell (a column of ``x``) ends in."""
        at, every = np.ones(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(self.depth):
            f = self.feature[t][at]
            at = np.where(f < 0, at, 2 * at + (x[f, every] > self.bin[t][at]))
        return at

    def margin(self, x: np.ndarray, n_trees: int) -> np.ndarray:
        out = np.zeros(x.shape[1])
        for t in range(n_trees):
            out += (self.step if t else 1.0) * self.value[t][self.nodes(x, t)]
        return out

    def split(self, level: int, sums: np.ndarray, min_instances: int, min_gain: float) -> None:
        """Splits the nodes of a level of the last tree, given (node, feature,
        bin) sums of weight, label and squared label."""
        feature, cut, value, impurity = self.feature[-1], self.bin[-1], self.value[-1], self.impurity[-1]
        for i in range(1 << level):
            node, total = (1 << level) + i, sums[i, 0].sum(0)
            if not total[0]:
                continue
            if level == 0:
                value[node], impurity[node] = total[1] / total[0], _variance(total)
            elif feature[node // 2] < 0 or abs(impurity[node]) < PURE:
                continue
            best = (0.0, None)
            for f, points in enumerate(self.points):
                if not len(points):
                    continue
                left = sums[i, f].cumsum(0)[:len(points)]
                right = sums[i, f].sum(0) - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = impurity[node] - left[:, 0] / total[0] * _variance(left) - right[:, 0] / total[0] * _variance(right)
                gain[(left[:, 0] < min_instances) | (right[:, 0] < min_instances) | ~(gain >= min_gain)] = -np.inf
                j = int(gain.argmax())
                if gain[j] > best[0]:  # the first of equal ones, as the estimator
                    best = (gain[j], (f, j, left[j], right[j]))
            if best[1]:
                feature[node], cut[node] = best[1][:2]
                for child, s in zip((2 * node, 2 * node + 1), best[1][2:]):
                    value[child], impurity[child] = s[1] / s[0], _variance(s)


def _variance(sums: np.ndarray) -> np.ndarray:
    """Population variance from (weight, label, squared label); none: 0."""
    n, s, ss = sums[..., 0], sums[..., 1], sums[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (ss - s * s / n) / n, 0.0)


def _cells_of(batch: pa.RecordBatch, models: dict[tuple, Trees], label: str):
    """(model's key, its cells' bins, rows of the batch, labels of -1 and 1)
    for every model with cells in the batch."""
    col = {n: batch.column(n) for n in batch.schema.names}
    y = 2.0 * col[label].to_numpy() - 1
    names, keep, fold = col["name"].to_numpy(zero_copy_only=False), col["keep"].to_numpy(), col["fold"].to_numpy()
    for view in sorted(set(zip(names.tolist(), keep.tolist(), fold.tolist()))):
        at = np.flatnonzero((names == view[0]) & (keep == view[1]) & (fold == view[2]))
        taken = {}
        for key, model in models.items():
            if key[1:] == view:
                for f in model.features:
                    if f not in taken:
                        taken[f] = col[f].take(pa.array(at)).to_numpy().astype(np.int64)
                yield key, np.array([taken[f] for f in model.features]), at, y[at]


def boost(cells: DataFrame, models: dict[tuple, Trees], label: str, estimator: GBTClassifier) -> None:
    """Grows the trees of all ``models`` ((encoding, name, keep, fold) -> no
    trees yet) with the estimator's parameters."""
    cells = cells.filter("part = 'fit'")
    numbers, n_bins = {key: i for i, key in enumerate(models)}, estimator.getMaxBins()
    min_instances, min_gain = estimator.getMinInstancesPerNode(), estimator.getMinInfoGain()
    for t in range(estimator.getMaxIter()):
        for m in models.values():
            m.start()
        for level in range(estimator.getMaxDepth()):
            def count(batches, t=t, level=level):
                sums: dict[tuple, np.ndarray] = {}
                for b in batches:
                    weights = b.column(f"bag_{t}").to_numpy().astype(float)
                    for key, x, at, y in _cells_of(b, models, label):
                        m, w = models[key], weights[at]
                        r = y if t == 0 else 4 * y / (1 + np.exp(2 * y * m.margin(x, t)))
                        node = m.nodes(x, t) - (1 << level)  # a leaf of a level above is below 0
                        use = np.flatnonzero((node >= 0) & (w > 0))
                        x, w, r, node = x[:, use], w[use], r[use], node[use]
                        own = sums.setdefault(key, np.zeros((3, (1 << level) * len(x) * n_bins)))
                        for f in range(len(x)):
                            place = (node * len(x) + f) * n_bins + x[f]
                            for s, v in zip(own, (w, w * r, w * r * r)):
                                s += np.bincount(place, v, len(s))
                for key, own in sums.items():
                    met = np.flatnonzero(own[0])
                    yield pa.RecordBatch.from_pydict({"model": np.full(len(met), numbers[key], np.int32), "place": met.astype(np.int32),
                                                      "w": own[0][met], "s": own[1][met], "ss": own[2][met]})

            some = cells.mapInArrow(count, "model int, place int, w double, s double, ss double")
            found = some.groupBy("model", "place").agg(*[F.sum(c).alias(c) for c in ("w", "s", "ss")]).toPandas()  # of the models' size
            for key, m in models.items():
                own = found[found.model == numbers[key]]
                sums = np.zeros(((1 << level) * len(m.features) * n_bins, 3))
                sums[own.place] = own[["w", "s", "ss"]]
                m.split(level, sums.reshape(1 << level, len(m.features), n_bins, 3), min_instances, min_gain)


def cell_scores(cells: DataFrame, models: dict[tuple, Trees], label: str) -> DataFrame:
    """(encoding, name, keep, fold, label, score, n): every model's scores of
    its fold's validation rows; rows of equal score and label are counted."""
    def score(batches):
        for b in batches:
            n = b.column("n").to_numpy().astype(float)
            for key, x, at, y in _cells_of(b, models, label):
                m = models[key]
                values, place = np.unique(1 / (1 + np.exp(-2 * m.margin(x, len(m.value)))), return_inverse=True)
                sums = np.bincount(2 * place + (y > 0), n[at], 2 * len(values))
                met = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([k] * len(met), t) for k, t in zip(key, (pa.string(), pa.string(), pa.int32(), pa.int32()))],
                    pa.array(met % 2, pa.int32()), pa.array(values[met // 2]), pa.array(sums[met])],
                    names=["encoding", "name", "keep", "fold", label, "score", "n"])

    schema = f"encoding string, name string, keep int, fold int, {label} int, score double, n double"
    return cells.filter("part = 'valid'").mapInArrow(score, schema)


def sweep_scores(rows: DataFrame, sets: dict[str, Sequence[str]], encodings: Sequence[str], plain: Sequence[str], label: str,
                 folds: Sequence[int], estimator: GBTClassifier) -> DataFrame:
    """A boosted model per encoding, set of categories, with and without the
    plain columns, and fold; returns the validation rows' scores, counted
    (:func:`cell_scores`), stored."""
    cells, points = count_cells(rows, sets, encodings, plain, label, folds, estimator)
    models = {}
    for e in encodings:
        for name, chosen in sets.items():
            for keep in (0, 1):
                features = [f"{e} {c}" for c in chosen] + list(plain) * keep
                for f in folds:
                    models[e, name, keep, f] = Trees(features, [points.get((f, x), np.empty(0)) for x in features],
                                                     estimator.getMaxDepth(), estimator.getStepSize())
    boost(cells, models, label, estimator)
    return cut_lineage(cell_scores(cells, models, label), "sweep-scores")
