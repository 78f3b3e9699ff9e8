"""Aggregations used as features or reports: frequency / count encodings,
group statistics broadcast back to rows, label rates, correlations,
histograms, five-number summaries, cross-tabulations.

Many columns with one statistic are unpivoted and aggregated in one
shuffle; the per-(col, value) results are joined back with one equi-join
per column.  Group statistics are aggregated then joined (not a window
partitioned by a low-cardinality column, which would be one task per
group).
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import lookup_back, unpivot_numeric


def frequency_encoding(df: DataFrame, cols: Sequence[str], out_fmt: str = "freq_{col}") -> DataFrame:
    """relative frequency of each exact numeric value among the rows of
    ``df`` that have one; null or unseen -> 0."""
    long = unpivot_numeric(df, cols, []).filter(F.col("value").isNotNull())
    cnt = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("c"))
    # n per column from the (col, value) table itself (no extra pass over
    # the rows); |cols| rows, broadcast
    n = cnt.groupBy("col").agg(F.sum("c").alias("n"))
    tab = cnt.join(F.broadcast(n), "col").select("col", "value", (F.col("c") / F.col("n")).alias("f"))
    return lookup_back(df, tab, cols, {"f": out_fmt}, default=F.lit(0.0))


def category_counts(df: DataFrame, cols: Sequence[str], rare_at: int = 50,
                    cnt_fmt: str = "cnt_{col}", rare_fmt: str = "rare_{col}") -> DataFrame:
    """count of each category over all rows (nulls counted as a value)
    and a rarity flag count <= ``rare_at``; null-safe join back."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    tab = (df.select(F.explode(arr).alias("kv")).select("kv.col", "kv.value")
           .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")))
    out = df
    for c in cols:
        t = tab.filter(F.col("col") == c).select(F.col("value").alias("_v"), F.col("n").alias(cnt_fmt.format(col=c)))
        out = out.withColumn("_k", F.col(c).cast("string"))
        out = out.join(t, out["_k"].eqNullSafe(t["_v"]), "left").drop("_k", "_v")
        out = out.withColumn(rare_fmt.format(col=c), (F.col(cnt_fmt.format(col=c)) <= rare_at).cast("int"))
    return out


def group_stats(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per (category, number): group mean broadcast to the rows,
    difference from it, and (x - mean) / (std + 1e-6) with sample std; a
    single-row group has std 0."""
    out = df
    by_cat: dict[str, list[str]] = {}
    for cat, num in pairs:
        by_cat.setdefault(cat, []).append(num)
    for cat, nums in by_cat.items():
        g = df.groupBy(cat).agg(*[x for n in nums for x in (
            F.avg(n).alias(f"{cat}_{n}_mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"_{cat}_{n}_sd"))])
        out = out.join(g, cat, "left")
        for n in nums:
            m, sd = F.col(f"{cat}_{n}_mean"), F.col(f"_{cat}_{n}_sd")
            out = out.withColumn(f"{cat}_{n}_diff", F.col(n) - m).withColumn(
                f"{cat}_{n}_norm", (F.col(n) - m) / (sd + 1e-6)).drop(f"_{cat}_{n}_sd")
    return out


def label_rate_compare(a: DataFrame, b: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """label rate per category in two populations, aligned on the
    category; a category missing on one side -> 0."""
    def rates(df, name):
        arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
        return (df.select(F.col(label).alias("_y"), F.explode(arr).alias("kv"))
                .groupBy("kv.col", "kv.value").agg(F.avg("_y").alias(name)))
    j = rates(a, "rate_a").join(rates(b, "rate_b"), ["col", "value"], "full")
    return j.select("col", "value", F.coalesce("rate_a", F.lit(0.0)).alias("rate_a"),
                    F.coalesce("rate_b", F.lit(0.0)).alias("rate_b"))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, one pass."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr"))
                    for a, b in pairs])
    return row.select(F.explode(arr).alias("p")).select("p.a", "p.b", "p.corr")


def histogram(df: DataFrame, col: str, bins: int, by: str) -> DataFrame:
    """equal-width histogram over [min, max] (last bin closed) per
    population ``by``, with density = count / (n_by * width)."""
    mm = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.crossJoin(F.broadcast(mm))  # one-row side
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    h = j.groupBy(by, b.alias("bin"), width.alias("width")).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_by"))
    return h.join(tot, by).select(
        by, "bin", "n", (F.col("n") / (F.col("n_by") * F.col("width"))).alias("density"))


def five_numbers(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """min, quartiles (linear), max per class, per column.  A class
    is a huge group: quantiles come from the histogram kernel, not from
    an exact-percentile aggregate that buffers a group's values."""
    from .rank import exact_quantiles
    long = unpivot_numeric(df, cols, [by])
    mm = long.groupBy(by, "col").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], [by, "col"])
    qw = q.groupBy(by, "col").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    return mm.join(qw, [by, "col"])  # both one row per (class, column)


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """counts of ``row`` x ``col`` with the column levels given (no
    extra pass to discover them), missing cells 0."""
    p = df.groupBy(row).pivot(col, list(levels)).count()
    return p.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"n_{v}") for v in levels])


# Aggregate columns per job: avg + stddev_pop keep 5 buffer fields per
# column, so 15 columns stay under spark.sql.codegen.maxFields (100) and
# the partial aggregate runs in whole-stage generated code.
STANDARDIZE_CHUNK = 15


def standardize(df: DataFrame, names: Sequence[str], by: str, fit: "F.Column") -> DataFrame:
    """(x - mean) / population std per ``by`` group, both fitted on
    the rows where ``fit`` holds (std 0 -> divide by 1).

    ``by`` must be a small fixed key (the outer fold number): the fitted
    statistics are one row per group, so the statistics table is
    broadcast.  Columns are aggregated in chunks of ``STANDARDIZE_CHUNK``
    so every partial aggregate stays inside generated code; the chunk
    tables (one row per group each) are joined on ``by``."""
    names = list(names)
    rows = df.filter(fit)
    st = None
    for i in range(0, len(names), STANDARDIZE_CHUNK):
        chunk = names[i:i + STANDARDIZE_CHUNK]
        part = rows.groupBy(by).agg(*[x for n in chunk for x in (
            F.avg(n).alias(f"_mu_{n}"), F.stddev_pop(n).alias(f"_sd_{n}"))])
        st = part if st is None else st.join(part, by)
    keep = [c for c in df.columns if c not in names]
    j = df.join(F.broadcast(st), by, "left")  # one row per group
    sd = {n: F.when(F.col(f"_sd_{n}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{n}")) for n in names}
    return j.select(*keep, *[((F.col(n) - F.col(f"_mu_{n}")) / sd[n]).alias(n) for n in names])
