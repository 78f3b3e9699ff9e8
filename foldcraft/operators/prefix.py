"""Exact running counts and row numbers without a one-task window.

A window ordered over a whole table (``row_number() over (order by x)``,
a cumulative sum over all distinct scores) runs in a single task.  The
kernels here compute the same numbers in three distributed steps:

1. give every row a *bucket* that is monotone in the ordering key: either
   a hash-prefix (for md5 keys) or a position among literal boundaries
   taken from ``approxQuantile`` (any boundaries are correct; they only
   balance the work);
2. count rows per (segment, bucket) -> a table of at most
   segments x buckets rows; running offsets are a window over that small
   table;
3. number / accumulate inside (segment, bucket) partitions and add the
   bucket offset.

Boundaries are literals fixed in the plan, so re-execution after a lost
executor or an AQE re-plan yields the same buckets.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Limits to the buckets of the value-ordered kernels; their number is the
# square root of the rows, which keeps both the rows per window partition and
# the offsets table (segments x buckets rows) small.
MIN_BUCKETS, MAX_BUCKETS = 16, 8192
# hex digits of the hash-ordered kernels: 16**3 = 4096 buckets per segment
# keeps a window partition near a million rows at ~4e9 rows per segment.
DEFAULT_HEX_DIGITS = 3


def bucket_count(n_rows: int) -> int:
    """Buckets for a stored table of ``n_rows`` rows."""
    return max(MIN_BUCKETS, min(MAX_BUCKETS, math.isqrt(n_rows)))


def quantile_boundaries(df: DataFrame, col: str, n_buckets: int = 1024,
                        rel_err: float | None = None) -> list[float]:
    """Strictly increasing literal cut points that split ``col`` evenly."""
    if n_buckets <= 1:
        return []
    if rel_err is None:
        rel_err = 1.0 / (4 * n_buckets)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.select(F.col(col).cast("double").alias(col)).approxQuantile(col, probs, rel_err)
    out: list[float] = []
    for q in qs:
        if q is None:
            continue
        q = float(q)
        if q != q:  # NaN
            continue
        if not out or q > out[-1]:
            out.append(q)
    return out


def with_value_bucket(df: DataFrame, col: str, boundaries: Sequence[float],
                      out: str = "_bkt") -> DataFrame:
    """Bucket id (int) monotone in ``col``: JVM binary search over literals."""
    if not boundaries:
        return df.withColumn(out, F.lit(0))
    tmp = f"{out}_v"
    # its search tells -0.0 from 0.0
    b = Bucketizer(splits=[float("-inf")] + [x + 0.0 for x in boundaries] + [float("inf")],
                   inputCol=tmp, outputCol=out, handleInvalid="keep")
    x = F.col(col).cast("double")
    res = b.transform(df.withColumn(tmp, F.when(x == 0, F.lit(0.0)).otherwise(x)))
    return res.withColumn(out, F.col(out).cast("int")).drop(tmp)


def hash_bucket(key: Column, hex_digits: int = DEFAULT_HEX_DIGITS) -> Column:
    """Bucket of an md5 hex key: its first ``hex_digits`` hex digits."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")


def _offsets(bucketed: DataFrame, segments: list[str], count_cols: dict[str, Column],
             bucket: str) -> DataFrame:
    """(segments, bucket) -> counts, running offsets and segment totals.

    The table has at most |segments| x |buckets| rows; its windows are
    partitioned by segment only, ordered over a few hundred buckets.
    """
    agg = bucketed.groupBy(*segments, bucket).agg(
        *[c.alias(f"_n_{name}") for name, c in count_cols.items()])
    w_before = (Window.partitionBy(*segments).orderBy(bucket)
                .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*segments)
    cols = []
    for name in count_cols:
        cols.append(F.coalesce(F.sum(f"_n_{name}").over(w_before), F.lit(0))
                    .alias(f"_off_{name}"))
        cols.append(F.sum(f"_n_{name}").over(w_all).alias(f"_tot_{name}"))
    return agg.select(*segments, bucket, *cols)


def _with_offsets(bucketed: DataFrame, offs: DataFrame, segments: list[str]) -> DataFrame:
    """Joins the offsets back, a null segment meeting its own; its size
    decides how."""
    o = offs.select(*[F.col(c).alias(f"_o_{c}") for c in [*segments, "_bkt"]],
                    *[c for c in offs.columns if c not in (*segments, "_bkt")])
    on = F.col("_bkt") == F.col("_o__bkt")
    for c in segments:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return bucketed.join(o, on).drop(*[f"_o_{c}" for c in [*segments, "_bkt"]])


def values_at_quantiles(hist: DataFrame, value: str, count: str, probs: Sequence[float],
                        segments: Sequence[str] = ()) -> DataFrame:
    """For a stored histogram with one row per (segments, value): rows
    (segments, p, pos, lo, hi) with pos = p (n - 1) and the values at the
    positions floor(pos) and ceil(pos) of the sorted rows.

    The offsets table says which bucket holds a position; only those buckets
    are read again, so thousands of probabilities cost no more than the rows
    of the buckets they hit."""
    segs = list(segments)
    b = with_value_bucket(hist, value, quantile_boundaries(hist, value, bucket_count(hist.count())))
    offs = cut_lineage(_offsets(b, segs, {"c": F.sum(count)}, "_bkt"), "offsets")
    points = hist.sparkSession.createDataFrame([(float(p),) for p in probs], ["p"])
    pos = F.col("p") * (F.col("_tot_c") - 1)
    wanted = offs.select(*segs, "_tot_c").distinct().crossJoin(F.broadcast(points)).select(  # |probs| rows
        *segs, "p", pos.alias("pos"), F.explode(F.array(
            F.struct(F.lit("lo").alias("end"), F.floor(pos).alias("at")),
            F.struct(F.lit("hi").alias("end"), F.ceil(pos).alias("at")))).alias("x")).select(*segs, "p", "pos", "x.end", "x.at")
    # the bucket of a position is the last one that begins at or before it
    begins = offs.select(*segs, F.col("_off_c").alias("at"), F.struct("_bkt", "_off_c").alias("b"), F.lit(0).alias("ask"))
    marks = begins.unionByName(wanted.select(*segs, "at").distinct().withColumn("ask", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*segs).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = marks.select(*segs, "at", "ask", F.last("b", ignorenulls=True).over(w).alias("b")).filter("ask = 1").select(
        *segs, "at", "b.*")
    hits = cut_lineage(hits, "positions")  # at most 2 |probs| rows per segment
    read = _with_offsets(b, hits.select(*segs, "_bkt", "_off_c").distinct(), segs)
    before = Window.partitionBy(*segs, "_bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    read = read.select(*segs, "_bkt", value, F.col(count).alias("_c"), (
        F.col("_off_c") + F.coalesce(F.sum(count).over(before), F.lit(0))).alias("_from"))
    found = _with_offsets(read, hits.select(*segs, "_bkt", "at"), segs).filter(
        (F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_from") + F.col("_c")))
    found = found.select(*[F.col(c).alias(f"_f_{c}") for c in segs], F.col("at").alias("_f_at"), F.col(value).alias("_v"))
    on = F.col("at") == F.col("_f_at")
    for c in segs:
        on = on & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    ends = wanted.join(found, on)
    return ends.groupBy(*segs, "p").agg(F.max("pos").alias("pos"), *[
        F.max(F.when(F.col("end") == e, F.col("_v"))).alias(e) for e in ("lo", "hi")])


def running_counts(hist: DataFrame, value: str, counts: Sequence[str],
                   segments: Sequence[str] = (), n_buckets: int | None = None,
                   boundaries: Sequence[float] | None = None) -> DataFrame:
    """For a histogram with one row per (segments, value), add for every
    count column ``c``: ``c_before`` (sum over strictly smaller values in the
    segment) and ``c_total`` (segment total).  Without given boundaries the
    histogram is stored first: they are taken from it, and the rows are not
    read again."""
    segments = list(segments)
    if boundaries is None:
        hist = cut_lineage(hist, "histogram")
        boundaries = quantile_boundaries(hist, value, n_buckets or bucket_count(hist.count()))
    b = with_value_bucket(hist, value, boundaries)
    offs = _offsets(b, segments, {c: F.sum(c) for c in counts}, "_bkt")
    w = (Window.partitionBy(*segments, "_bkt").orderBy(value)
         .rowsBetween(Window.unboundedPreceding, -1))
    local = b.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_loc_{c}")
                            for c in counts])
    j = _with_offsets(local, offs, segments)
    out = j.select(*hist.columns,
                   *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{c}_before")
                     for c in counts],
                   *[F.col(f"_tot_{c}").alias(f"{c}_total") for c in counts])
    return out


def row_number_by_hash(df: DataFrame, key: Column, segments: Sequence[str] = (),
                       out: str = "rn", hex_digits: int = DEFAULT_HEX_DIGITS,
                       tiebreak: str | None = None, required: str | None = None,
                       wanted: Callable[[Column], Column] | None = None, stored: bool = False) -> DataFrame:
    """0-based row number ordered by an md5 hex ``key`` inside ``segments``,
    plus ``<out>_n`` = segment size.  Equals
    ``row_number() over (partition by segments order by key) - 1``; nulls of
    a segment column form a segment, or are an error that gives their number
    if the column is ``required``.  ``wanted`` (segment size -> count) keeps
    the first so many rows of each segment: buckets that begin behind them are
    dropped before the numbering, so they are not shuffled.  ``stored`` keeps
    the offsets as a table, so that its size is known when the join back is
    planned: a small one is sent to the rows, which are then shuffled for the
    numbering only (``df`` is read twice either way)."""
    segments = list(segments)
    b = df.withColumn("_key", key).withColumn("_bkt", hash_bucket(F.col("_key"), hex_digits))
    offs = _offsets(b, segments, {"r": F.count(F.lit(1))}, "_bkt")
    if required:  # the check reads the counts that are there anyway
        offs = offs.withColumn("_off_r", F.when(F.col(required).isNotNull(), F.col("_off_r")).otherwise(
            F.raise_error(F.concat(F.col("_tot_r").cast("string"), F.lit(f" rows have no {required}")))))
    if stored:
        offs = cut_lineage(offs, "offsets")
    order = [F.col("_key")] + ([F.col(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(*segments, "_bkt").orderBy(*order)
    j = _with_offsets(b, offs, segments)
    if wanted is not None:
        j = j.filter(F.col("_off_r") < wanted(F.col("_tot_r")))
    j = j.select(*df.columns,
                 (F.row_number().over(w) - 1 + F.col("_off_r")).cast("long").alias(out),
                 F.col("_tot_r").cast("long").alias(f"{out}_n"))
    return j if wanted is None else j.filter(F.col(out) < wanted(F.col(f"{out}_n")))


def row_number_in_order(df: DataFrame, segment: str, order: Sequence[str], out: str = "rn") -> DataFrame:
    """0-based row number inside ``segment`` by columns of any type (strings
    have no literal boundaries), nulls first, plus ``<out>_n`` = segment size.

    Rows are cut into ranges of (segment, order), stored, and numbered inside
    them; a range's offset comes from the counts, of which there is at most
    one per range and segment more.  ``df`` is read twice: store it first."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.repartitionByRange(ranges, segment, *order).withColumn("_bkt", F.spark_partition_id()), "ranges")
    offs = _offsets(d, [segment], {"r": F.count(F.lit(1))}, "_bkt")
    place = F.row_number().over(Window.partitionBy(segment, "_bkt").orderBy(*order)) - 1
    j = _with_offsets(d.withColumn("_place", place), offs, [segment])
    return j.select(*df.columns, (F.col("_off_r") + F.col("_place")).alias(out), F.col("_tot_r").alias(f"{out}_n"))


def row_number_by_value(df: DataFrame, order_col: str, segments: Sequence[str] = (),
                        out: str = "rn", n_buckets: int = 1024,
                        tiebreak: str | None = None) -> DataFrame:
    """0-based row number ordered by a numeric column inside ``segments``
    (ties broken by ``tiebreak``), plus ``<out>_n`` = segment size."""
    segments = list(segments)
    bounds = quantile_boundaries(df, order_col, n_buckets)
    b = with_value_bucket(df, order_col, bounds)
    offs = _offsets(b, segments, {"r": F.count(F.lit(1))}, "_bkt")
    order = [F.col(order_col)] + ([F.col(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(*segments, "_bkt").orderBy(*order)
    j = _with_offsets(b, offs, segments)
    return j.select(*df.columns,
                    (F.row_number().over(w) - 1 + F.col("_off_r")).cast("long").alias(out),
                    F.col("_tot_r").cast("long").alias(f"{out}_n"))
