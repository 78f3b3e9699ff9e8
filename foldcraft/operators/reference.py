"""Reference-population features: place every row inside the distribution
of a small labelled reference table (rates per value and per pair,
percentile rank inside label subsets, z-scores, quantile distances,
segment-conditional ranks and residuals).

The reference statistics are aggregates (one row per value, pair, segment
or subset); they are joined back with equi-joins.  Ranks use the
distinct-value histogram of ``rank.reference_rank`` so no range join or
one-task window is needed even when the reference is large.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encode as E
from .rank import reference_rank


def ref_rate(rows: DataFrame, ref: DataFrame, cols: Sequence[str], label: str,
             unseen: float = 0.5, out_fmt: str = "orig_{col}") -> DataFrame:
    """Mean reference label per value (categorical or numeric)."""
    return E.encode_full(ref, rows, cols, {"r": E.raw_mean(unseen)}, prefix_fmt=out_fmt,
                         label=label, unseen=unseen)


def ref_rate_pairs(rows: DataFrame, ref: DataFrame, pairs: Sequence[tuple[str, str]], label: str,
                   unseen: float = 0.5, out_fmt: str = "orig_{a}_{b}") -> DataFrame:
    """Mean reference label per value pair, two-key left join."""
    out = rows
    for a, b in pairs:
        name = out_fmt.format(a=a, b=b)
        t = ref.groupBy(a, b).agg(F.avg(label).alias(name))
        out = out.join(t, [a, b], "left").withColumn(name, F.coalesce(F.col(name), F.lit(unseen)))
    return out


def subsets(label: str) -> dict[str, Column]:
    return {"ch": F.col(label) == 1, "nc": F.col(label) == 0, "all": F.lit(True)}


def ref_pct(rows: DataFrame, ref: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """count(ref_subset < x) / n_subset for churners / non-churners / all."""
    return reference_rank(rows, ref, cols, subsets(label))


def ref_zscore(rows: DataFrame, ref: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Z against the churner and non-churner subsets (population std,
    std 0 -> z 0) and the gap |z_ch| - |z_nc|."""
    aggs = []
    for c in cols:
        for k, cond in (("ch", F.col(label) == 1), ("nc", F.col(label) == 0)):
            v = F.when(cond, F.col(c).cast("double"))
            aggs += [F.avg(v).alias(f"_mu_{k}_{c}"), F.stddev_pop(v).alias(f"_sd_{k}_{c}")]
    st = ref.agg(*aggs)
    j = rows.crossJoin(F.broadcast(st))  # one-row side
    out = []
    for c in cols:
        zs = {}
        for k in ("ch", "nc"):
            sd = F.col(f"_sd_{k}_{c}")
            zs[k] = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_mu_{k}_{c}")) / sd)
            out.append(zs[k].alias(f"z_{k}_{c}"))
        out.append((F.abs(zs["ch"]) - F.abs(zs["nc"])).alias(f"zgap_{c}"))
    return j.select(*rows.columns, *out)


def ref_quantile_dist(rows: DataFrame, ref: DataFrame, cols: Sequence[str], label: str,
                      qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """|x - q| for the subset quartiles (linear) and the gap nc - ch.
    Quantiles per (subset, column) from the histogram kernel."""
    from .rank import exact_quantiles, unpivot_numeric
    long = unpivot_numeric(ref.withColumn("_k", F.when(F.col(label) == 1, "ch").when(F.col(label) == 0, "nc")),
                           cols, ["_k"]).filter(F.col("_k").isNotNull())
    qt = exact_quantiles(long, "value", list(qs), ["_k", "col"])
    # one row: |subsets| x |cols| x |qs| values pivoted with literal names
    st = qt.agg(*[F.max(F.when((F.col("_k") == k) & (F.col("col") == c) & (F.col("p") == q), F.col("q")))
                  .alias(f"_q{int(q * 100)}_{k}_{c}") for c in cols for k in ("ch", "nc") for q in qs])
    j = rows.crossJoin(F.broadcast(st))  # one-row side
    out = []
    for c in cols:
        for q in qs:
            t = int(q * 100)
            d = {k: F.abs(F.col(c) - F.col(f"_q{t}_{k}_{c}")) for k in ("ch", "nc")}
            out += [d["ch"].alias(f"qd{t}_ch_{c}"), d["nc"].alias(f"qd{t}_nc_{c}"),
                    (d["nc"] - d["ch"]).alias(f"qdgap{t}_{c}")]
    return j.select(*rows.columns, *out)


def ref_segment_pct(rows: DataFrame, ref: DataFrame, col: str, segment: str) -> DataFrame:
    """Rank of ``col`` among reference rows of the same segment; a
    segment absent from the reference -> 0."""
    return reference_rank(rows, ref, [col], {"all": F.lit(True)},
                          out_fmt="segpct_" + segment + "_{col}", segment=segment, absent=0.0)


def ref_segment_resid(rows: DataFrame, ref: DataFrame, col: str, segment: str) -> DataFrame:
    """X minus the reference mean of its segment; unseen segment mean 0."""
    m = ref.groupBy(segment).agg(F.avg(col).alias("_segmean"))
    j = rows.join(m, segment, "left")
    return j.withColumn(f"resid_{segment}_{col}", F.col(col) - F.coalesce(F.col("_segmean"), F.lit(0.0))
                        ).drop("_segmean")
