"""Evaluation, blending and sweeps as aggregations over scored rows.

Scores are columns of a keyed DataFrame (id, score columns, label).  A
weight or threshold sweep is a cross join with a parameter table of fixed,
small size followed by one grouped aggregate (AUC segmented by the
parameter), so every grid point is computed in the same job.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rank import auc


def blend_tables(preds: Sequence[tuple[DataFrame, float]], id_col: str = "id",
                 score: str = "p") -> DataFrame:
    """Weighted blend sum(w_i p_i) / sum(w_i) of N prediction
    tables keyed by id (union + one grouped aggregate, not a positional
    alignment and not N-1 joins)."""
    u = None
    for df, w in preds:
        part = df.select(id_col, F.col(score).cast("double").alias("_p"), F.lit(float(w)).alias("_w"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy(id_col).agg((F.sum(F.col("_w") * F.col("_p")) / F.sum("_w")).alias("blend"))


#: (row, weight) pairs whose histogram one job makes: it has about as many rows
#: when scores are all different, and a task holds its share of them
PAIRS_AT_ONCE = 32_000_000


def weight_grid_auc(df: DataFrame, a: str, b: str, label: str, weights: Sequence[float], at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """M2 / M3: AUC of w*a + (1-w)*b for every w: in one job while rows x
    weights stay within ``at_once``, else as many weights at a time as do (one
    at least), each job's few rows being stored.  So a task's memory grows with
    the rows, not with rows x weights."""
    spark = df.sparkSession

    def some(part: Sequence[float]) -> DataFrame:
        wt = spark.createDataFrame([(float(w),) for w in part], "w double")
        x = df.select(a, b, label).crossJoin(F.broadcast(wt))  # |weights| rows
        x = x.withColumn("_s", F.col("w") * F.col(a) + (F.lit(1.0) - F.col("w")) * F.col(b))
        return auc(x, "_s", label, ["w"])

    per = max(1, at_once // max(1, df.count()))
    if per >= len(weights):
        return some(weights)
    return reduce(DataFrame.unionByName, [cut_lineage(some(weights[i:i + per]), "grid") for i in range(0, len(weights), per)])


#: the golden ratio's inverse, by which each step narrows the bracket
GOLDEN = (5 ** 0.5 - 1) / 2


def search_weight(df: DataFrame, a: str, b: str, label: str, low: float = 0.0, high: float = 1.0,
                  tolerance: float = 1e-4) -> tuple[float, float]:
    """M3: the weight in [low, high] of the best AUC of w*a + (1-w)*b, by
    golden section: each step narrows the bracket by one evaluation, so some
    20 over the stored scores come down to 1e-4 (a grid of that width would be
    10,000).  Equal AUCs (to 9 digits) keep the lower half.  Returns the
    last bracket's better point and its AUC."""
    rows = cut_lineage(df.select(a, b, label), "blend-scores")

    def value(w: float) -> float:
        s = F.lit(w) * F.col(a) + (F.lit(1.0) - F.lit(w)) * F.col(b)
        return round(auc(rows.select(s.alias("_b"), label), "_b", label).first()["auc"], 9)  # one number

    x, y = high - (high - low) * GOLDEN, low + (high - low) * GOLDEN
    at_x, at_y = value(x), value(y)
    for _ in range(math.ceil(math.log(tolerance / (high - low)) / math.log(GOLDEN))):
        if at_x >= at_y:
            high, y, at_y = y, x, at_x
            x = high - (high - low) * GOLDEN
            at_x = value(x)
        else:
            low, x, at_x = x, y, at_y
            y = low + (high - low) * GOLDEN
            at_y = value(y)
    return (x, at_x) if at_x >= at_y else (y, at_y)


def error_overlap(df: DataFrame, a: str, b: str, label: str, t: float = 0.5) -> DataFrame:
    """Agreement of two classifiers' errors at threshold t."""
    ra = ((F.col(a) > t).cast("int") == F.col(label))
    rb = ((F.col(b) > t).cast("int") == F.col(label))

    def cnt(e: Column):
        return F.sum(e.cast("int")).cast("long")
    n = F.count(F.lit(1))
    return df.agg(cnt(ra & rb).alias("both_right"), cnt(~ra & ~rb).alias("both_wrong"),
                  cnt(ra & ~rb).alias("only_a"), cnt(~ra & rb).alias("only_b"),
                  (cnt(ra) / n).alias("acc_a"), (cnt(rb) / n).alias("acc_b"),
                  ((cnt(ra & ~rb) + cnt(~ra & rb)) / n).alias("complementarity"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 20) -> DataFrame:
    """Uniform bins, right-closed (p in ((k)/B, (k+1)/B], 0 in bin 0);
    mean prediction and positive share, empty bins absent."""
    b = F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(score).alias("mean_pred"), F.avg(label).alias("pos_share"),
                                          F.count(F.lit(1)).alias("n"))


def score_summary(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Min / max / mean / population std / share above .5."""
    return df.groupBy(*by).agg(F.min(score).alias("min"), F.max(score).alias("max"),
                               F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                               F.avg((F.col(score) > 0.5).cast("double")).alias("share_gt_05"))


def log_loss(df: DataFrame, score: str, label: str, eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy, probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
