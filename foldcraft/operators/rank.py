"""Ranks and codes: average-tie percentile rank, searchsorted rank inside a
reference subset, sorted / first-seen codes, exact ROC AUC.

All of them reduce rows to a distinct-value histogram first (map-side
partial aggregation: a hot value is one row after the exchange), run the
bucketed running count of ``prefix.running_counts`` over it, and equi-join
the per-value result back.  No global window, no range join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prefix import row_number_in_order, running_counts, values_at_quantiles


def unpivot_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., col, value double): numbers keyed by value, not text.
    -0.0 is read as 0 and NaN as null, so equal numbers share one key."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value"))
                    for c in cols])
    long = df.select(*keep, F.explode(arr).alias("_kv")).select(*keep, "_kv.col", "_kv.value")
    return long.withColumn("value", number_key(F.col("value")))


def number_key(v: Column) -> Column:
    """A number as a key: one zero, NaN as null."""
    return F.when(v == 0, F.lit(0.0)).when(~F.isnan(v), v)


def lookup_back(rows: DataFrame, table: DataFrame, cols: Sequence[str], stats: dict[str, str],
                keys: Sequence[str] = (), default: Column | None = None) -> DataFrame:
    """Join per-(col, value) statistics back onto the wide rows, one left
    equi-join per column (AQE picks broadcast when the table is small)."""
    out = rows
    for c in cols:
        t = table.filter(F.col("col") == c).select(
            *keys, F.col("value").alias("_v"),
            *[F.col(src).alias(fmt.format(col=c)) for src, fmt in stats.items()])
        out = out.withColumn("_v", number_key(F.col(c).cast("double"))).join(
            t, on=[*keys, "_v"], how="left").drop("_v")
        if default is not None:
            for fmt in stats.values():
                out = out.withColumn(fmt.format(col=c), F.coalesce(F.col(fmt.format(col=c)), default))
    return out


def pct_rank(df: DataFrame, cols: Sequence[str], out_fmt: str = "rank_{col}") -> DataFrame:
    """G1r: pandas ``rank(method='average', pct=True)`` over all rows of df:
    (count(< x) + (count(= x) + 1) / 2) / n.  Nulls keep a null rank."""
    long = unpivot_numeric(df, cols, []).filter(F.col("value").isNotNull())
    hist = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("c"))
    rc = running_counts(hist, "value", ["c"], ["col"])
    rc = rc.select("col", "value", ((F.col("c_before") + (F.col("c") + 1) / 2.0) / F.col("c_total")).alias("r"))
    return lookup_back(df, rc, cols, {"r": out_fmt})


def reference_rank(rows: DataFrame, ref: DataFrame, cols: Sequence[str],
                   subsets: dict[str, Column], out_fmt: str = "pct_{subset}_{col}",
                   segment: str | None = None, absent: float | None = None) -> DataFrame:
    """Position of each row's value inside a reference subset,
    ``searchsorted(sorted_ref, x, 'left') / n_ref`` = count(ref < x) / n_ref.

    The histogram is the union of the rows' distinct values (count 0) and
    the reference values (count per subset), so the lookup is an equi-join.
    ``segment``: rank inside the reference rows of the same segment value;
    a segment absent from the reference gives ``absent``.
    """
    seg = [segment] if segment else []
    keep = seg
    ref_long = unpivot_numeric(ref.select(*seg, *cols, *[e.alias(f"_s_{k}") for k, e in subsets.items()]),
                               cols, [*keep, *[f"_s_{k}" for k in subsets]])
    ref_h = ref_long.filter(F.col("value").isNotNull()).groupBy(*seg, "col", "value").agg(
        *[F.sum(F.col(f"_s_{k}").cast("long")).alias(f"n_{k}") for k in subsets])
    row_long = unpivot_numeric(rows.select(*seg, *cols), cols, keep).filter(F.col("value").isNotNull())
    row_h = row_long.select(*seg, "col", "value").distinct().select(
        *seg, "col", "value", *[F.lit(0).cast("long").alias(f"n_{k}") for k in subsets])
    hist = ref_h.unionByName(row_h).groupBy(*seg, "col", "value").agg(
        *[F.sum(f"n_{k}").alias(f"n_{k}") for k in subsets])
    rc = running_counts(hist, "value", [f"n_{k}" for k in subsets], [*seg, "col"])
    outs = {}
    for k in subsets:
        tot = F.col(f"n_{k}_total")
        val = F.when(tot > 0, F.col(f"n_{k}_before") / tot)
        if absent is not None:
            val = F.coalesce(val, F.lit(absent))
        outs[k] = val
    rc = rc.select(*seg, "col", "value", *[outs[k].alias(f"_p_{k}") for k in subsets])
    out = rows
    for c in cols:
        t = rc.filter(F.col("col") == c).select(
            *seg, F.col("value").alias("_v"),
            *[F.col(f"_p_{k}").alias(out_fmt.format(subset=k, col=c)) for k in subsets])
        out = out.withColumn("_v", number_key(F.col(c).cast("double"))).join(
            t, on=[*seg, "_v"], how="left").drop("_v")
        if absent is not None:
            for k in subsets:
                o = out_fmt.format(subset=k, col=c)
                out = out.withColumn(o, F.coalesce(F.col(o), F.lit(absent)))
    return out


def sorted_codes(fit: DataFrame, rows: DataFrame, cols: Sequence[str],
                 out_fmt: str = "code_{col}") -> DataFrame:
    """G2r: code = position of the value among the sorted distinct values
    of ``fit``; null (or a value absent from ``fit``) -> -1.  The distinct
    strings are numbered in ranges, so a column with as many values as rows
    is many tasks."""
    long = fit.select(*[F.col(c).cast("string").alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols])
    d = long.select(F.explode(arr).alias("kv")).select("kv.col", "kv.value").filter(
        F.col("value").isNotNull()).distinct()
    codes = cut_lineage(row_number_in_order(cut_lineage(d, "dictionary"), "col", ["value"], "code"), "codes")
    out = rows
    for c in cols:
        t = codes.filter(F.col("col") == c).select(F.col("value").alias("_v"),
                                                   F.col("code").alias(out_fmt.format(col=c)))
        out = (out.withColumn("_v", F.col(c).cast("string")).join(t, "_v", "left").drop("_v")
               .withColumn(out_fmt.format(col=c), F.coalesce(F.col(out_fmt.format(col=c)), F.lit(-1))))
    return out


def first_seen_codes(fit: DataFrame, rows: DataFrame, cols: Sequence[str], order_col: str = "id",
                     out_fmt: str = "fcode_{col}") -> DataFrame:
    """G3r: ``factorize`` order: categories numbered by first appearance
    (smallest ``order_col``) in ``fit``; unseen -> -1.  The code is the
    number of categories seen earlier: a running count over the
    (col, first appearance) table, so even a numeric-as-category column
    with many values is numbered without a one-task window."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    d = (fit.select(order_col, F.explode(arr).alias("kv")).select(order_col, "kv.col", "kv.value")
         .filter(F.col("value").isNotNull())
         .groupBy("col", "value").agg(F.min(order_col).alias("first"))
         .withColumn("one", F.lit(1)))
    codes = running_counts(d, "first", ["one"], ["col"]).select(
        "col", "value", F.col("one_before").alias("code"))
    out = rows
    for c in cols:
        t = codes.filter(F.col("col") == c).select(F.col("value").alias("_v"),
                                                   F.col("code").alias(out_fmt.format(col=c)))
        out = (out.withColumn("_v", F.col(c).cast("string")).join(t, "_v", "left").drop("_v")
               .withColumn(out_fmt.format(col=c), F.coalesce(F.col(out_fmt.format(col=c)), F.lit(-1))))
    return out


def auc(df: DataFrame, score: str, label: str, segments: Sequence[str] = (),
        weight: str | None = None) -> DataFrame:
    """Exact ROC AUC (ties count one half), per segment:
    sum_s pos_s * (neg_<s + neg_s / 2) / (P * N).

    Rows -> (segment, score) histogram of positives / negatives -> bucketed
    running count of negatives -> one aggregate; rows without a score (null or
    NaN) are left out.  Output (segments..., auc, n_pos, n_neg)."""
    segs = list(segments)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hist = (df.select(*segs, number_key(F.col(score).cast("double")).alias("_s"), F.col(label).alias("_y"), w.alias("_w"))
            .filter(F.col("_s").isNotNull())
            .groupBy(*segs, "_s")
            .agg(F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("pos"),
                 F.sum(F.when(F.col("_y") == 1, 0.0).otherwise(F.col("_w"))).alias("neg")))
    return _auc_of_histogram(hist, segs)


def auc_of_counts(counts: DataFrame, score: str, pos: str, neg: str, segments: Sequence[str] = ()) -> DataFrame:
    """N1 from rows (segments, score, positives, negatives): for scores that
    are functions of a value, computed once per value."""
    segs = list(segments)
    hist = counts.select(*segs, number_key(F.col(score).cast("double")).alias("_s"), pos, neg).filter(F.col("_s").isNotNull())
    return _auc_of_histogram(hist.groupBy(*segs, "_s").agg(
        F.sum(F.col(pos).cast("double")).alias("pos"), F.sum(F.col(neg).cast("double")).alias("neg")), segs)


def _auc_of_histogram(hist: DataFrame, segs: list[str]) -> DataFrame:
    rc = running_counts(hist, "_s", ["neg"], segs)
    agg = rc.groupBy(*segs).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_num"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(*segs, (F.col("_num") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      "n_pos", "n_neg")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    segments: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles (numpy 'linear', SQL
    ``quantile_cont``) per segment without gathering a group's values in
    one task; null and NaN are left out.

    Rows -> (segments, value) histogram (partial aggregation) -> values at
    the positions floor(p(n-1)) and ceil(p(n-1)), read from the buckets that
    hold such a position -> lo + (hi - lo) * frac.
    Output (segments..., p, q)."""
    segs = list(segments)
    hist = (df.select(*segs, number_key(F.col(value).cast("double")).alias("_x")).filter(F.col("_x").isNotNull())
            .groupBy(*segs, "_x").agg(F.count(F.lit(1)).alias("_c")))
    found = values_at_quantiles(cut_lineage(hist, "histogram"), "_x", "_c", probs, segs)
    q = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor(F.col("pos")))
    return found.select(*segs, "p", q.alias("q"))
